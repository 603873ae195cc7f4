"""Formats of analysed texts, as Columns over an array of morphemes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EOS = "\nEOS\n"


def detailed(ms: Column, details: bool = False, tab: str = "\t", delimiter: str = "\n", eos: str = EOS) -> Column:
    """surface, POS and normalized form; with ``details`` also forms, ids, synonyms and (OOV)."""

    def one(m: Column) -> Column:
        parts = [m["surface"], F.array_join(m["pos"], ","), m["normalized_form"]]
        if details:
            parts += [m["dictionary_form"], m["reading_form"], m["dictionary_id"].cast("string"), F.concat(F.lit("["), F.array_join(F.transform(m["synonym_group_ids"], lambda x: x.cast("string")), ","), F.lit("]")), F.when(m["is_oov"], "(OOV)")]
        return F.concat_ws(tab, *parts)

    return F.concat(F.array_join(F.transform(ms, one), delimiter), F.lit(eos))


def wakati(ms: Column, delimiter: str = " ", eos: str = "\n") -> Column:
    """Surfaces joined by the delimiter; empty ones and the delimiter itself are left out."""
    surfaces = F.filter(F.transform(ms, lambda m: m["surface"]), lambda s: (s != "") & (s != delimiter))
    return F.concat(F.array_join(surfaces, delimiter), F.lit(eos))


def path_cost(ms: Column) -> Column:
    """Total of the last morpheme less that of the first; 0 for an empty list."""
    return F.when(F.size(ms) > 0, F.element_at(ms, -1)["total_cost"] - ms[0]["total_cost"]).otherwise(F.lit(0).cast("long"))
