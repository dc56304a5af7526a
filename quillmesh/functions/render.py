"""Text for people: dependency trees, hierarchies, reports, narratives (G3, G6, T4, T7, Q28, R18). All work on few rows on the driver."""

from __future__ import annotations

import difflib

MOST_ROWS = 1000


def _rows(df, most: int) -> tuple[list, list[str]]:
    """At most so many rows, and a line that says so if there are more."""
    rows = df.limit(most + 1).collect()
    return rows[:most], [f"... only the first {most} rows are shown"] if len(rows) > most else []


def shorten(text: str, most: int = 50) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


def specifiers(names: list[dict]) -> str:
    """Imported names as they are written, at most 50 characters."""
    one = lambda s: f"* as {s['alias']}" if s["is_namespace"] and s["alias"] else f"{s['name']} as {s['alias']}" if s["alias"] else s["name"]
    return shorten(", ".join(map(one, names)))


def tree(edges, root: str, external: set[str] = frozenset(), depth: int = 5, most: int = MOST_ROWS) -> str:
    """The tree below a root; a node that stands above itself is marked circular, an unresolved one external (G3). Edges are read level by level, only those below the root."""
    children: dict[str, list[str]] = {}
    front, n, note = [root], 0, []
    for _ in range(depth + 1):
        if not front:
            break
        rows, more = _rows(edges.filter(edges["src"].isin(front)).select("src", "dst").distinct().orderBy("src", "dst"), most)
        for f in front:
            children[f] = []
        for r in rows:
            children[r["src"]].append(r["dst"])
        n, note = n + len(rows), note or more
        front = sorted({r["dst"] for r in rows} - set(children))
        if n > most or note:
            note = note or [f"... only the first {n} edges are shown"]
            break
    out = [root]

    def walk(node: str, above: tuple[str, ...]) -> None:
        for c in children.get(node, []) if len(above) <= depth else []:
            mark = " (circular)" if c in above else " [external]" if c in external else ""
            out.append("  " * len(above) + c + mark)
            if not mark:
                walk(c, (*above, c))

    walk(root, (root,))
    return "\n".join(out + note)


def hierarchy(levels, title: str, most: int = MOST_ROWS) -> str:
    """Nodes grouped by level."""
    out = [f"# {title}"]
    last = None
    rows, note = _rows(levels.orderBy("depth", "node"), most)
    for r in rows:
        if r["depth"] != last:
            out.append(f"## Level {r['depth']}")
            last = r["depth"]
        out.append(f"- {r['node']}")
    return "\n".join(out + note)


def did_you_mean(name: str, known: list[str], most: int = 5) -> str:
    """A line for a name that wasn't found (T4)."""
    close = difflib.get_close_matches(name, known, most, 0.6)
    return f"{name} was not found." + (f" Did you mean {', '.join(close)}?" if close else "")


def table(df, columns: list[str], most: int = MOST_ROWS) -> str:
    """Tab-separated rows under a head line."""
    cell = lambda v: "" if v is None else str(v).replace("\t", "    ").replace("\r\n", "\\n").replace("\n", "\\n")
    rows, note = _rows(df.select(*columns), most)
    return "\n".join(["\t".join(columns), *("\t".join(cell(r[c]) for c in columns) for r in rows), *note])


def narrative(module: str, files: int, exports: list[str], topics: list[str]) -> str:
    """A sentence about a module, with topics only where it exports something (Q28)."""
    text = f"{module}: {files} file{'s' if files != 1 else ''}"
    if exports:
        text += f"; exports {', '.join(exports[:5])}" + (f" and {len(exports) - 5} more" if len(exports) > 5 else "")
        text += f"; about {', '.join(topics[:6])}" if topics else ""
    return text + "."
