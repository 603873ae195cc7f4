"""What the kinds of plugins have to offer. All are pickled to the tasks with the engine."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame

if TYPE_CHECKING:
    from ..functions.normalize import Edited
    from ..plans.dictionary import Compiled
    from .lattice import Chars, Lattice, Node


class Plugin(ABC):
    """``set_up`` is called once with the compiled dictionary, before any text."""

    def set_up(self, dictionary: Compiled) -> None:  # noqa: B027
        pass


class InputText(Plugin):
    @abstractmethod
    def rewrite(self, text: Edited) -> None:
        """Change the text in place, by its ``replace`` or ``replace_all``."""


class OovProvider(Plugin):
    @abstractmethod
    def provide(self, chars: Chars, at: int, seen: set[int]) -> Sequence[Node]:
        """Nodes that begin at ``at``; ``seen`` has the lengths of those already there."""

    def idle(self, chars: Chars) -> np.ndarray | None:
        """For each character whether there is no node at it, whatever else there is; None if that isn't known."""
        return None


class PathRewrite(Plugin):
    def validate_split_mode(self, mode: str) -> None:  # noqa: B027
        """Raise a ValueError for a mode that the plugin can't serve."""

    @abstractmethod
    def rewrite(self, chars: Chars, path: list[Node], lattice: Lattice) -> list[Node]:
        """The path to go on with."""


class ConnectionEdit(Plugin):
    @abstractmethod
    def edit(self, connection: DataFrame, lexicon: DataFrame) -> DataFrame:
        """The connection table (left, right, cost) to go on with."""


class Formatter(Plugin):
    @abstractmethod
    def __call__(self, morphemes: Column) -> Column:
        """Text of an array of morphemes."""
