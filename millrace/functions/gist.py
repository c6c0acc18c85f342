"""Summaries of files from their symbols and imports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import GIST_CHARS, GIST_DEPENDENCIES, GIST_DOC, GIST_FUNCTIONS


def gist(symbols: Column, imports: Column) -> Column:
    """One line on what a file defines and uses: arrays of (name, type, docstring) and of (source), in order.

    A function is followed by the start of the first line of its docstring.
    """
    of = lambda *kinds: F.filter(symbols, lambda s: s["type"].isin(*kinds))
    doc = lambda s: F.left(F.split(s["docstring"], "\n")[0], F.lit(GIST_DOC))
    structures = F.transform(of("class", "interface", "struct"), lambda s: s["name"])
    logic = F.transform(F.slice(of("function", "method"), 1, GIST_FUNCTIONS), lambda s: F.when(F.coalesce(s["docstring"], F.lit("")) == "", s["name"]).otherwise(F.concat(s["name"], F.lit(" ("), doc(s), F.lit(")"))))
    outside = F.slice(F.transform(F.filter(imports, lambda i: ~i["source"].startswith(".")), lambda i: F.element_at(F.split(i["source"], "/"), -1)), 1, GIST_DEPENDENCIES)

    def part(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(title), F.array_join(items, ", "), F.lit(".")))

    whole = F.concat_ws(" ", part("Core structures: ", structures), part("Key logic: ", logic), part("Integrates with: ", outside))
    return shortened(whole)


def shortened(text: Column, most: int = GIST_CHARS) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
