"""Scalar functions as column expressions, and the few that need Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_TOKENS = ("the", "and", "of", "to", "in", "a", "is")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up (F1)."""
    return F.ceil(F.length(text) / 4).cast("long")


def truncate_lines(text: Column, most: Column | int, marker: str = "...") -> Column:
    """Whole lines as long as they fit in `most` characters, then a marker."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(acc: Column, line: Column) -> Column:
        size = acc["n"] + F.length(line) + F.when(acc["n"] > 0, 1).otherwise(0)
        fits = ~acc["full"] & (size <= most)
        return F.struct(F.when(fits, F.when(acc["n"] > 0, F.concat(acc["kept"], F.lit("\n"), line)).otherwise(line)).otherwise(acc["kept"]).alias("kept"), F.when(fits, size).otherwise(acc["n"]).cast("int").alias("n"), (~fits).alias("full"))

    cut = F.aggregate(lines, start, add)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut["kept"], F.lit(f"\n{marker}")))


def cut_bytes(text: str | None, most: int, marker: str = "...") -> str | None:
    """At most `most` UTF-8 bytes, marker included, never half a character."""
    if text is None or len(data := text.encode()) <= most:
        return text
    return data[: max(0, most - len(marker.encode()))].decode(errors="ignore") + marker


def cut_bytes_column(most: int, marker: str = "..."):
    """The same as an Arrow function, to be called by name in SQL."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_bytes(t, most, marker))

    return cut


def bytes_within(text: Column, most: int, marker: str = "...") -> Column:
    """The same by built-in functions: of the bytes that fit, up to three that begin a character are left out."""
    room, data = max(0, most - len(marker.encode())), text.cast("binary")
    whole = [F.try_validate_utf8(F.substring(data, 1, max(0, room - less)).cast("string")) for less in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.coalesce(*whole), F.lit(marker)))


def tsv_cell(value: Column) -> Column:
    """Tabs as four blanks, line ends as a backslash and n, null as nothing."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, "\t", "    "), "\r?\n", r"\\n")


def markdown_cell(value: Column) -> Column:
    """Pipes escaped, line ends as blanks."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\|", r"\\|"), "\r?\n", " ")


def one_blank(signature: Column) -> Column:
    """Runs of white space as one blank."""
    return F.trim(F.regexp_replace(signature, r"\s+", " "))


def numbered_line(number: Column, line: Column, width: int = 4) -> Column:
    """A source line behind its padded number."""
    return F.concat(F.lpad(number.cast("string"), width, " "), F.lit(" | "), line)


def symbol_id(path: Column, name: Column, kind: Column, line: Column) -> Column:
    return F.concat_ws(":", path, name, kind, line.cast("string"))


def format_bytes(n: Column) -> Column:
    """Bytes, or KB and MB with one digit."""
    kb = F.round(n / 1024, 1).cast("decimal(18,1)").cast("string")
    mb = F.round(n / 1048576, 1).cast("decimal(18,1)").cast("string")
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def relative_path(path: Column, root: str) -> Column:
    """The path below the root."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path)


def usage_cost(inputs: Column, outputs: Column, cache_reads: Column, cache_writes: Column, prices: tuple[float, float, float, float]) -> Column:
    """Cost of tokens by four prices for a million each."""
    return sum((c * p for c, p in zip((inputs, outputs, cache_reads, cache_writes), prices, strict=True)), F.lit(0.0)) / 1e6


def semantic_tokens(name: Column) -> Column:
    """Words of a camel or snake name, without stop words and short ones."""
    parts = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_TOKENS))


def rubric(text: Column, groups: list[list[str]], claims: list[str], truths: list[str]) -> dict[str, Column]:
    """Completeness, accuracy, specificity and their composite of an answer.

    A group is met if all its patterns match; accuracy is the share of claims made that are true, one where all are, none without claims.
    """
    met = [F.lit(True) if not g else None for g in groups]
    met = [m if m is not None else F.forall(F.array(*[F.lit(p) for p in g]), lambda p: F.regexp_like(text, p)) for m, g in zip(met, groups, strict=True)]
    complete = sum((m.cast("double") for m in met), F.lit(0.0)) / max(1, len(groups))
    made = sum((text.rlike(p).cast("int") for p in claims), F.lit(0))
    right = sum((text.rlike(p).cast("int") for p in truths), F.lit(0))
    accuracy = F.when(made > 0, right / made).otherwise(0.0)
    places = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\w/]+\.[a-z]{2,4}"), 0))) + F.size(F.regexp_extract_all(text, F.lit(r":\d+"), 0))
    specific = F.least(places / 8.0, F.lit(1.0))
    return {"completeness": complete, "accuracy": accuracy, "specificity": places.cast("long"), "composite": complete * 0.5 + accuracy * 0.4 + specific * 0.1}


#: Names of types across languages.
TYPESCRIPT_TYPES = {
    "string": "String", "number": "Number", "boolean": "Boolean", "void": "Void", "null": "Null", "undefined": "Undefined", "any": "Any", "unknown": "Unknown", "never": "Never", "object": "Object", "Array": "Array",
    "Promise": "Promise", "Map": "Map", "Set": "Set", "Date": "Date", "Error": "Error", "Function": "Function", "Symbol": "Symbol", "BigInt": "BigInt", "Uint8Array": "ByteArray", "Buffer": "ByteArray",
    "ReadonlyArray": "Array", "Awaited": "Awaited", "Partial": "Partial", "Required": "Required", "Readonly": "Readonly", "Record": "Record", "Pick": "Pick", "Omit": "Omit", "Exclude": "Exclude", "Extract": "Extract",
    "NonNullable": "NonNullable", "ReturnType": "ReturnType", "Parameters": "Parameters", "InstanceType": "InstanceType",
}
PYTHON_TYPES = {
    "str": "String", "int": "Number", "float": "Number", "bool": "Boolean", "None": "Void", "NoneType": "Void", "bytes": "ByteArray", "bytearray": "ByteArray", "list": "Array", "List": "Array", "tuple": "Tuple", "Tuple": "Tuple",
    "dict": "Map", "Dict": "Map", "set": "Set", "Set": "Set", "frozenset": "Set", "FrozenSet": "Set", "Awaitable": "Promise", "Coroutine": "Promise", "Future": "Promise", "Optional": "Nullable", "Union": "Union",
    "Callable": "Function", "Any": "Any", "object": "Object", "type": "Type", "Type": "Type", "Sequence": "Array", "Iterable": "Iterable", "Iterator": "Iterator", "Generator": "Generator", "AsyncGenerator": "AsyncGenerator",
    "Mapping": "Map", "MutableMapping": "Map", "TypeVar": "TypeVar", "Generic": "Generic",
}
NOTHING = ("null", "undefined", "none")


def split_arguments(text: str) -> list[str]:
    """Parts between commas outside all brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<[({") - (c in ">])}" and not (c == ">" and text[i - 1 : i] == "="))
        if c == "," and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    return [p for p in [*out, text[at:].strip()] if p]


def _alternatives(text: str) -> list[str]:
    """Parts between bars outside all brackets."""
    marked, depth = [], 0
    for i, c in enumerate(text):
        depth += (c in "<[({") - (c in ">])}" and not (c == ">" and text[i - 1 : i] == "="))
        marked.append("\0" if c == "|" and depth == 0 else c)
    return [p.strip() for p in "".join(marked).split("\0") if p.strip()]


def _shape(text: str, language: str) -> tuple[str, list[str]]:
    """Outer name and arguments of a type without its empty alternatives."""
    parts = [p for p in _alternatives(text) if p.lower() not in NOTHING]
    if len(parts) > 1:
        return "Union", parts
    one = parts[0] if parts else text.strip()
    if one.endswith("[]") and len(one) > 2:
        return "Array", [one[:-2].strip()]
    opened, closed = (r"\[", r"\]") if language == "python" else ("<", ">")
    m = re.fullmatch(rf"([A-Za-z_]\w*)\s*{opened}(.+){closed}", one, re.S)
    return (m[1], split_arguments(m[2])) if m else (one, [])


def parse_type(text: str | None, language: str = "typescript") -> dict | None:
    """raw, normalized, base, inner, and flags of a type annotation; None for none and for types of no value."""
    if not text or not text.strip() or text in ("void", "None"):
        return None
    t = text.strip()
    names = PYTHON_TYPES if language == "python" else TYPESCRIPT_TYPES
    alternatives = _alternatives(t)
    nullable = len(alternatives) > 1 and NOTHING.count(alternatives[0].lower()) + NOTHING.count(alternatives[-1].lower()) > 0 or bool(re.match(r"optional\s*[\[<]", t, re.I))
    is_async = bool(re.match(r"(promise|awaitable|coroutine|future|async)\s*[<\[]", t, re.I))
    is_array = t.endswith("[]") or bool(re.match(r"([Aa]rray|list|List|Sequence|ReadonlyArray)\s*[<\[]", t))
    base, arguments = _shape(t, language)
    base = names.get(base, base)
    inner = [(parse_type(a, language) or {"normalized": a})["normalized"] for a in arguments]
    normalized = f"{base}<{', '.join(inner)}>" if inner else base
    normalized = f"Array<{normalized}>" if is_array and base != "Array" else normalized
    normalized = f"Promise<{normalized}>" if is_async and base != "Promise" else normalized
    return {
        "raw": text, "normalized": f"{normalized} | null" if nullable else normalized, "base": base.lower(), "inner": ",".join(inner).lower(), "is_async": is_async, "is_nullable": nullable, "is_array": is_array, "is_generic": bool(arguments),
    }


TYPE_SCHEMA = "raw string, normalized string, base string, inner string, is_async boolean, is_nullable boolean, is_array boolean, is_generic boolean"


EMPTY_TYPE = dict.fromkeys(c.split()[0] for c in TYPE_SCHEMA.split(", "))


def parse_type_column():
    """A column function of types, read as TypeScript."""

    @F.pandas_udf(TYPE_SCHEMA)
    def parse(types: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_type(t) or EMPTY_TYPE for t in types], columns=list(EMPTY_TYPE))

    return parse


def parse_types_of():
    """A column function of types and their languages."""

    @F.pandas_udf(TYPE_SCHEMA)
    def parse(types: pd.Series, languages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_type(t, x) or EMPTY_TYPE for t, x in zip(types, languages, strict=True)], columns=list(EMPTY_TYPE))

    return parse
