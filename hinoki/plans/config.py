"""Configuration and the plugin registry."""

from __future__ import annotations

import importlib
import json
import os
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.charclass import Categories, parse_char_definition
from ..functions.definitions import CHARACTERS, UNKNOWN_WORDS
from ..functions.normalize import DefaultRewrite, ProlongedMarks, StripRuby
from ..operators.lattice import CategoryOov, CounterOov, JoinKatakana, JoinNumeric, RegexOov, SimpleOov
from ..operators.plugins import ConnectionEdit, InputText, OovProvider, PathRewrite
from ..operators.tokenize import Engine
from ..sources import lexicon as src
from .dictionary import Compiled, Dictionary, inhibit, targeted

PLUGINS = {c.__name__: c for c in (DefaultRewrite, ProlongedMarks, StripRuby, SimpleOov, CategoryOov, RegexOov, CounterOov, JoinNumeric, JoinKatakana)}
NOUN = ("名詞", "普通名詞", "一般", "*", "*", "*")
ALIASES = {"userDicts": "userDict"}


def find_file(path: str, anchors: Sequence[str] = ()) -> str:
    """The first existing place of a path under the anchors, else under the first anchor."""
    if os.path.isabs(path) or "://" in path or not anchors:
        return path
    places = [os.path.join(a, path) for a in anchors]
    return next((p for p in places if os.path.exists(p)), places[0])


@dataclass
class Config:
    """A JSON map; ``with_fallback`` fills keys that are missing."""

    values: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Config:
        values = json.loads(text)
        if not isinstance(values, dict):
            raise ValueError("the root of a configuration is an object")
        return cls({ALIASES.get(k, k): v for k, v in values.items()})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Config:
        return cls.parse("\n".join(src.read_lines(spark, path)))

    def with_fallback(self, other: Config) -> Config:
        return Config(other.values | self.values)

    def _get(self, key: str, kind, default):
        v = self.values.get(key, default)
        if v is not None and not isinstance(v, kind):
            raise TypeError(f"{key} is not of the expected type")
        return v

    def string(self, key: str, default: str | None = None) -> str | None:
        return self._get(key, str, default)

    def number(self, key: str, default: int = 0) -> int:
        return self._get(key, (int, float), default)

    def flag(self, key: str, default: bool = False) -> bool:
        return self._get(key, bool, default)

    def items(self, key: str) -> list:
        return self._get(key, list, []) or []


def attribute(name: str):
    """What ``module:name`` or ``module.name`` stands for."""
    module, _, name = name.replace(":", ".").rpartition(".")
    if not module:
        raise ValueError(f"unknown plugin {name}")
    return getattr(importlib.import_module(module), name)


def plugin(name: str, **options):
    """A built-in by its name or last dotted component, else ``module:Class`` or ``module.Class``."""
    known = PLUGINS.get(name) or PLUGINS.get(name.rpartition(".")[2]) or attribute(name)
    return known(**options)


def plugins(config: Config, key: str, kind: type, default: Sequence) -> list:
    """Plugins of a list of {"class": name, ...}; a missing or empty list means the default."""
    found = [plugin(p["class"], **{k: v for k, v in p.items() if k != "class"}) for p in config.items(key)]
    for p in found:
        if not isinstance(p, kind):
            raise TypeError(f"{type(p).__name__} in {key} is no {kind.__name__}")
    return found or list(default)


def default_oov(categories: dict | None = None, rules: Sequence = (), register: bool = True) -> list:
    first = [CounterOov()]
    if categories and rules:
        first.append(CategoryOov(categories, rules, register))
    return [*first, SimpleOov(NOUN, cost=30000, register=register)]


def _covers(compiled: Compiled, rules: Sequence) -> bool:
    return all(left < compiled.cols and right < compiled.rows for _, left, right, _, _ in rules)


def connection_edits(config: Config, dictionary: Dictionary) -> DataFrame:
    """The dictionary's connections after the edits of the configuration, in their order.

    An edit is {"inhibitPair": [[left, right], ...]}, {"rules": [...]} between entries,
    or {"class": name, ...} for a plugin of one's own.
    """
    connection = dictionary.connection
    for edit in config.items("editConnectionCostPlugin"):
        if "inhibitPair" in edit:
            connection = inhibit(connection, edit["inhibitPair"])
        elif "rules" in edit:
            six = lambda pos: (list(pos) + ["*"] * 6)[:6]
            rows = [(r["left"]["surface"], six(r["left"]["pos"]), r["left"]["reading"], r["right"]["surface"], six(r["right"]["pos"]), r["right"]["reading"], r["cost"], i) for i, r in enumerate(edit["rules"])]
            rules = connection.sparkSession.createDataFrame(rows, "l_surface string, l_pos array<string>, l_reading string, r_surface string, r_pos array<string>, r_reading string, cost int, seq int")
            connection = targeted(connection, dictionary.lexicon, rules)
        else:
            own = plugin(edit["class"], **{k: v for k, v in edit.items() if k != "class"})
            if not isinstance(own, ConnectionEdit):
                raise TypeError(f"{type(own).__name__} is no ConnectionEdit")
            connection = own.edit(connection, dictionary.lexicon)
    return connection


def engine(dictionary: Dictionary, config: Config | None = None, char_definition: Sequence[str] | None = None, unknown_rules: Sequence[str] | None = None, rewrite_rules: Sequence[str] | None = None) -> Engine:
    """The default profile over a dictionary: connection edits, then input, OOV and path plugins.

    Definitions that aren't given are the packaged ones. The packaged unknown-word rules
    name ids of a large matrix; with a smaller one they are left out with a warning. An
    empty list of rules leaves them out without one; given rules must fit.
    """
    config = config or Config()
    compiled = Dictionary(dictionary.lexicon, dictionary.pos, connection_edits(config, dictionary)).compile()
    ranges, categories = parse_char_definition(CHARACTERS if char_definition is None else char_definition)
    rules = src.parse_unknown_rules(list(UNKNOWN_WORDS if unknown_rules is None else unknown_rules))
    if unknown_rules is None and not config.items("oovProviderPlugin") and not _covers(compiled, rules):
        warnings.warn("the packaged unknown-word rules need a larger connection matrix and are left out", stacklevel=2)
        rules = []
    rewrite = DefaultRewrite.standard() if rewrite_rules is None else DefaultRewrite.from_lines(rewrite_rules)
    return Engine(
        compiled,
        plugins(config, "inputTextPlugin", InputText, [rewrite]),
        plugins(config, "oovProviderPlugin", OovProvider, default_oov(categories, rules)),
        plugins(config, "pathRewritePlugin", PathRewrite, [JoinNumeric(), JoinKatakana(NOUN, register=True)]),
        Categories(ranges),
    )
