"""Fields of parsed JSON lines as Columns. A field of another type than asked for counts as absent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpline.functions.text import let, rfc3339, trim_space

TITLES = ("title", "name", "summary", "aiTitle", "customTitle")
TODO_LISTS = ("phases", "items", "todos", "tasks")
COMMAND_RUNES = 500


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def type_of(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def string(v: Column, path: str) -> Column:
    """A string field, else an empty string; numbers and objects are not read as strings."""
    return F.when(type_of(at(v, path)) == "STRING", F.try_variant_get(v, path, "string")).otherwise("")


def is_true(v: Column, path: str) -> Column:
    return F.coalesce((type_of(at(v, path)) == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))


def present(v: Column) -> Column:
    """A variant, or null if it is JSON null or an empty string."""
    return let(v, lambda x: F.when(~((type_of(x) == "VOID") | ((type_of(x) == "STRING") & (F.try_variant_get(x, "$", "string") == ""))), x))


def first_of(v: Column, *paths: str) -> Column:
    return F.coalesce(*[present(at(v, p)) for p in paths])


def moment(v: Column, *paths: str) -> Column:
    """Unix seconds of the first field present: a number (milliseconds above 1e10) or an RFC 3339 string, else 0."""

    def seconds(x: Column) -> Column:
        number = F.try_variant_get(x, "$", "double")
        scaled = F.when(number > 1e10, F.floor(F.try_variant_get(x, "$", "long") / 1000)).otherwise(number.cast("long"))
        kind = type_of(x)
        digits = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
        return F.when(kind == "STRING", rfc3339(F.try_variant_get(x, "$", "string"))).when(digits, F.coalesce(scaled, F.lit(0))).otherwise(0).cast("long")

    return let(first_of(v, *paths), seconds)


def spoken(v: Column, path: str) -> Column:
    """A string's trimmed text, or the texts of an array's parts but its thinking, on lines of their own."""
    said = lambda p: F.when(~string(p, "$.type").isin("thinking", "reasoning"), trim_space(string(p, "$.text")))
    heard = lambda parts: F.array_join(F.filter(F.transform(parts, said), lambda t: t != ""), "\n")
    return F.coalesce(heard(F.try_variant_get(v, path, "array<variant>")), trim_space(string(v, path)))


def compact(v: Column) -> Column:
    """JSON text with sorted keys and escaped angle brackets and ampersands; empty for null."""

    def text(x: Column) -> Column:
        escaped = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), (("<", r"\u003c"), (">", r"\u003e"), ("&", r"\u0026")), F.to_json(x))
        return F.when(type_of(x) == "VOID", "").otherwise(F.coalesce(escaped, F.lit("")))

    return let(v, text)


def _labelled(label: str, text: Column, after: str) -> Column:
    return F.coalesce(F.concat(F.lit(label + after), F.nullif(text, F.lit(""))), F.lit(""))


def title(v: Column, source: Column | str, under: str = "$") -> Column:
    named = F.coalesce(*[F.nullif(trim_space(string(v, f"{under}.{k}")), F.lit("")) for k in TITLES])
    source = F.lit(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("TITLE "), source, F.lit(": "), named), F.lit(""))


def tool_result(v: Column, name: str, under: str = "$") -> Column:
    said = spoken(v, f"{under}.content")
    data = compact(first_of(v, *[f"{under}.{k}" for k in ("details", "data", "result")]))
    return _labelled(f"TOOL {name} RESULT", F.coalesce(F.nullif(said, F.lit("")), data), ":\n")


def todo(v: Column, source: str, under: str = "$") -> Column:
    """The first task list in details, data or the record itself; else its details or data; else what it says."""
    lists = [first_of(v, *[f"{place}.{k}" for k in TODO_LISTS]) for place in (f"{under}.details", f"{under}.data", under)]
    state = compact(F.coalesce(*lists, first_of(v, f"{under}.details", f"{under}.data")))
    return _labelled(f"TODO {source}", F.coalesce(F.nullif(state, F.lit("")), spoken(v, f"{under}.content")), ":\n")


def command(v: Column, under: str = "$") -> Column:
    """A described shell command; without a description it is left out."""
    what, how = trim_space(string(v, f"{under}.description")), trim_space(string(v, f"{under}.command"))
    cut = F.when(F.char_length(how) > COMMAND_RUNES, F.concat(F.left(how, F.lit(COMMAND_RUNES)), F.lit("…"))).otherwise(how)
    return F.when((what != "") & (how != ""), F.concat(F.lit("Ran: "), what, F.lit("\n$ "), cut)).otherwise("")
