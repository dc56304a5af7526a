"""Schemas of the canonical relations that parsing gives."""

from __future__ import annotations

from quillmesh.operators.postings import LENGTHS, POSTINGS, TERMS

FILES = "file_path string, relative_path string, language string, checksum string, last_modified timestamp, summary string, line_count int, file_size bigint, parse_status string"
SYMBOLS = (
    "id string, file_path string, name string, fully_qualified_name string, kind string, signature string, language string, line_start int, line_end int, local_name string, parent_function string, parent_class string, nesting_depth int, "
    "is_exported boolean, is_async boolean, is_private boolean, is_static boolean, is_abstract boolean, is_generator boolean, callback_context string, return_type string, doc string, params array<struct<name:string,type:string,optional:boolean,has_default:boolean,rest:boolean>>"
)
REFS = "symbol_name string, referencing_file string, referencing_symbol_name string, line_number int, column_number int, context string, reference_kind string"
CALLS = "file_path string, caller_symbol_id string, caller_name string, callee_name string, call_count bigint, is_async boolean, is_conditional boolean"
TYPE_RELS = "file_path string, source_symbol_id string, source_name string, target_name string, target_name_base string, relationship_kind string"
IMPORTS = "file_path string, import_source string, is_type_only boolean, is_re_export boolean, specifiers array<struct<name:string,alias:string,is_default:boolean,is_namespace:boolean>>"
EXPORTS = "file_path string, export_name string, is_default boolean, is_re_export boolean, re_export_source string"
CONFIG = "id string, file_path string, name string, path string, value_type string, value string, depth int, parent_path string, format string, config_type string, description string, line_number int"
TRANSITIONS = "chain string, from_id string, from_name string, to_id string, to_name string, raw double, prob double"
CHAINS = "chain_id string, chain string, total_states bigint, total_transitions bigint, updated_at timestamp"
#: Tables that aren't replaced by file.
DERIVED = {
    "transitions": TRANSITIONS, "chains": CHAINS,
    "chain_states": "chain string, owner string, state string, key string, u double, v double, df bigint", "chain_members": "chain string, owner string, key string, state string, v double, df bigint",
    "chain_sums": "chain string, owner string, key string, df bigint, n bigint, whole double", "chain_links": "owner string, from_id string, to_id string, raw double", "chain_names": "owner string, name string, id string", "chain_counts": "files bigint",
}
#: Relations whose rows are found by their words, and the columns that are searched.
SEARCHED = {"symbols": ("name", "fully_qualified_name", "signature"), "config_entries": ("path", "value")}
RELATIONS = {"files": FILES, "symbols": SYMBOLS, "refs": REFS, "calls": CALLS, "type_rels": TYPE_RELS, "imports": IMPORTS, "exports": EXPORTS, "config_entries": CONFIG}
#: Column that names the file a row comes from.
OWNER = {n: "referencing_file" if n == "refs" else "file_path" for n in RELATIONS} | {f"{n}_{part}": "file_path" for n in SEARCHED for part in ("postings", "lengths")}
#: Tables of the chains' factors that are replaced by file, not with the relations but when factors are brought up to date, and the order they lie in.
CHAINED = {"chain_states": ("chain", "state"), "chain_members": ("chain", "key"), "chain_sums": ("chain", "key"), "chain_links": ("from_id",), "chain_names": ("name",)}
OWNED = OWNER | dict.fromkeys(CHAINED, "owner")
POSTED = {f"{n}_{part}": schema for n in SEARCHED for part, schema in (("postings", POSTINGS), ("terms", TERMS), ("lengths", LENGTHS))}
RELATIONS_AND_DERIVED = RELATIONS | DERIVED | POSTED

#: Language by file ending.
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".pyi": "python", ".json": "config", ".yaml": "config", ".yml": "config", ".toml": "config"}


def symbol(path: str, language: str, name: str, kind: str, start: int, end: int, **more) -> dict:
    """A row of symbols; what isn't given is null, or no for flags."""
    parent = more.get("parent_class")
    row = {
        "id": f"{path}:{name}:{kind}:{start}", "file_path": path, "name": name, "fully_qualified_name": f"{path.rsplit('.', 1)[0]}#{parent + '.' if parent else ''}{name}", "kind": kind, "signature": "", "language": language,
        "line_start": start, "line_end": end, "local_name": name.rsplit(".", 1)[-1], "nesting_depth": 0, "params": [],
    }
    row |= dict.fromkeys(("parent_function", "parent_class", "callback_context", "return_type", "doc"))
    row |= dict.fromkeys(("is_exported", "is_async", "is_private", "is_static", "is_abstract", "is_generator"), False)
    return row | more


def parameter(name: str, kind: str | None = None, optional: bool = False, has_default: bool = False, rest: bool = False) -> dict:
    return {"name": name, "type": kind, "optional": optional, "has_default": has_default, "rest": rest}


def collapse(calls: list[dict]) -> list[dict]:
    """One row for each caller and callee, with a count and the flags of the first call (A5)."""
    out: dict[tuple, dict] = {}
    for c in calls:
        key = c["caller_symbol_id"], c["callee_name"]
        if key in out:
            out[key]["call_count"] += 1
        else:
            out[key] = c | {"call_count": 1}
    return list(out.values())
