"""Doc comments taken apart: tags of block comments, sections of docstrings (S6o, S7d)."""

from __future__ import annotations

import inspect
import re

import pandas as pd
from pyspark.sql import functions as F

SCHEMA = (
    "description string, params array<struct<name:string,type:string,description:string>>, returns string, deprecated string, throws array<string>, examples array<string>, "
    "tags array<struct<name:string,text:string>>"
)
NONE = {"description": None, "params": [], "returns": None, "deprecated": None, "throws": [], "examples": [], "tags": []}
SECTION = re.compile(r"^(args|arguments|parameters|params|returns?|yields?|raises?|throws|examples?|notes?)\s*:?\s*$", re.I)


def parse_block(comment: str | None) -> dict | None:
    """A /** ... */ comment; None if there is nothing in it."""
    lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in re.sub(r"^\s*/\*\*|\*/\s*$", "", comment or "").split("\n")]
    parts: list[tuple[str, list[str]]] = [("", [])]
    for line in lines:
        if m := re.match(r"\s*@(\w+)\s?(.*)$", line):
            parts.append((m[1], [m[2]]))
        else:
            parts[-1][1].append(line)
    out = {k: v[:] if isinstance(v, list) else v for k, v in NONE.items()}
    for tag, body in parts:
        text = "\n".join(body).strip()
        if not tag:
            out["description"] = text or None
        elif tag in ("param", "arg", "argument"):
            m = re.match(r"(?:\{(?P<type>[^}]*)\}\s*)?\[?(?P<name>[\w.$]+)[^\s\]]*\]?\s*(?:-\s*)?(?P<text>.*)$", text, re.S)
            out["params"].append({"name": m["name"], "type": m["type"], "description": m["text"].strip()} if m else {"name": text, "type": None, "description": ""})
        elif tag in ("returns", "return"):
            out["returns"] = re.sub(r"^\{[^}]*\}\s*", "", text)
        elif tag == "deprecated":
            out["deprecated"] = text
        elif tag in ("throws", "exception"):
            out["throws"].append(re.sub(r"^\{([^}]*)\}\s*", r"\1: ", text))
        elif tag == "example":
            out["examples"].append(text)
        else:
            out["tags"].append({"name": tag, "text": text})
    return out if any(out.values()) else None


def _sections(doc: str) -> list[tuple[str, list[str], bool]]:
    """Head (empty for the description), lines, and whether the head is ruled, of each section."""
    lines, out, i = doc.split("\n"), [("", [], False)], 0
    while i < len(lines):
        m = SECTION.match(lines[i].strip())
        ruled = i + 1 < len(lines) and re.fullmatch(r"\s*-{3,}\s*", lines[i + 1]) is not None
        if m and (ruled or lines[i].rstrip().endswith(":")):
            out.append((m[1].lower().rstrip("s"), [], ruled))
            i += 1 + ruled
            continue
        out[-1][1].append(lines[i])
        i += 1
    return out


def _entries(lines: list[str], join: str = " ") -> list[str]:
    """Entries of a section: a line of the least indent begins one, deeper lines go on with it."""
    own = [x for x in lines if x.strip()]
    least = min((len(x) - len(x.lstrip()) for x in own), default=0)
    out: list[str] = []
    for x in own:
        if len(x) - len(x.lstrip()) == least or not out:
            out.append(x.strip())
        else:
            out[-1] += (join if join not in out[-1] else " ") + x.strip()
    return out


def parse_docstring(doc: str | None) -> dict | None:
    """Description, arguments, results, errors and examples; None for an empty docstring."""
    if not doc or not doc.strip():
        return None
    out = {k: v[:] if isinstance(v, list) else v for k, v in NONE.items()}
    for head, lines, ruled in _sections(inspect.cleandoc(doc)):
        text = inspect.cleandoc("\n".join(lines)).strip() if lines else ""
        if head in ("arg", "argument", "parameter", "param"):
            for e in _entries(lines, "\n"):
                first, _, rest = e.partition("\n")
                if ruled:  # name : type, and the description below
                    name, _, kind = (x.strip() for x in first.partition(":"))
                    out["params"].append({"name": name, "type": kind or None, "description": rest})
                    continue
                m = re.match(r"(\*{0,2}\w+)\s*(?:\(([^)]*)\))?\s*:\s*(.*)$", first)
                text = f"{m[3] if m else ''} {rest}".strip()
                out["params"].append({"name": m[1], "type": m[2], "description": text} if m else {"name": first, "type": None, "description": text})
        elif head in ("return", "yield"):
            out["returns"] = " ".join(_entries(lines)) or None
        elif head in ("raise", "throw"):
            out["throws"] += _entries(lines)
        elif head == "example":
            out["examples"].append(text)
        elif head == "note":
            out["tags"].append({"name": "note", "text": text})
        elif text:
            out["description"] = text
    return out


def doc_details():
    """A column function of doc and language."""

    @F.pandas_udf(SCHEMA)
    def details(doc: pd.Series, language: pd.Series) -> pd.DataFrame:
        found = [(parse_docstring if lang == "python" else parse_block)(d) or NONE for d, lang in zip(doc, language, strict=True)]
        return pd.DataFrame(found, columns=list(NONE))

    return details
