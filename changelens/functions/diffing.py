"""Differences of two snapshots: unified lines, and blocks aligned in their context."""

from __future__ import annotations

import difflib
from itertools import zip_longest

from changelens.functions.markup import canonical, flat, serialize

CONTEXT_BLOCKS, PRECEDING_CHARS = 3, 160
COMPARED = ("paragraph", "table", "list")


def unified(previous: str, current: str, whole: bool = False) -> str:
    """Unified line difference with three lines of context, or with all of the texts; empty for equal texts."""
    a, b = previous.splitlines(), current.splitlines()
    return "\n".join(difflib.unified_diff(a, b, "previous", "current", lineterm="", n=max(len(a), len(b), 1) if whole else 3))


def _short(text: str) -> str:
    text = " ".join(text.split())
    return text if len(text) <= PRECEDING_CHARS else text[:PRECEDING_CHARS] + "…"


def annotate(blocks: list[dict]) -> list[dict]:
    """Comparable blocks with their heading path, the block before and the last three of context."""
    out, path, before, recent = [], [], None, []
    for b in flat(blocks):
        if b["type"] == "heading":
            path = [h for h in path if h[0] < b["level"]] + [(b["level"], b["text"])]
        elif b["type"] in COMPARED:
            out.append({"block": b, "path": list(path), "preceding": before, "context": list(recent), "key": (b["type"], tuple(path), canonical(b))})
        before = _short(serialize([b]))
        recent = [*recent, {"type": b["type"], "text": before}][-CONTEXT_BLOCKS:]
    return out


def cells_of(before: list[str], after: list[str], headers: list[str], old_headers: list[str]) -> list[dict]:
    out = []
    for k, (a, b) in enumerate(zip_longest(before, after)):
        if a != b:
            name = headers[k] if k < len(headers) and headers[k] else old_headers[k] if k < len(old_headers) and old_headers[k] else f"column_{k + 1}"
            out.append({"column": name, "previous": a, "current": b})
    return out


def aligned(a: list, b: list):
    """(kind, item of a, item of b) of everything that differs: replaced slices pair up by position."""
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        n = min(i2 - i1, j2 - j1)
        yield from (("pair", i1 + k, j1 + k) for k in range(n))
        yield from (("deleted", i, None) for i in range(i1 + n, i2))
        yield from (("added", None, j) for j in range(j1 + n, j2))


def table_rows(old: dict, new: dict) -> list[dict]:
    """Row changes: by the first cell where it names every row of both sides, else by position."""
    args = new["headers"], old["headers"]
    sides = [[r[0] if r else "" for r in t["rows"]] for t in (old, new)]
    if all(all(map(str.strip, s)) and len(set(s)) == len(s) for s in sides):
        before, after = (dict(zip(s, t["rows"], strict=True)) for s, t in zip(sides, (old, new), strict=True))
        out = []
        for key in [*before, *(k for k in after if k not in before)]:
            a, b = before.get(key), after.get(key)
            if a != b:
                out.append({"change": "added" if a is None else "deleted" if b is None else "modified", "row_key": key, "changed_cells": cells_of(a or [], b or [], *args)})
        return out
    rows = [list(map(tuple, t["rows"])) for t in (old, new)]
    out = []
    for kind, i, j in aligned(*rows):
        if kind == "pair":
            out.append({"change": "modified", "row_key": None, "changed_cells": cells_of(old["rows"][i], new["rows"][j], *args)})
        else:
            out.append({"change": kind, "row_key": None, "changed_cells": []})
    return out


def list_items(block: dict, parents: tuple = ()) -> list[tuple[tuple, str]]:
    """(path of parents, text) of each item, nested ones after theirs."""
    out = []
    for item in block["items"]:
        out.append((parents, item["text"]))
        for child in item["children"]:
            out.extend(list_items(child, (*parents, item["text"])))
    return out


def list_changes(old: dict, new: dict) -> list[dict]:
    """Item changes; an item under another parent is gone there and new here."""
    a, b = list_items(old), list_items(new)
    out = []
    for kind, i, j in aligned(a, b):
        if kind == "pair" and a[i][0] == b[j][0]:
            out.append({"change": "modified", "parents": list(a[i][0]), "previous": a[i][1], "current": b[j][1]})
            continue
        if i is not None:
            out.append({"change": "deleted", "parents": list(a[i][0]), "previous": a[i][1], "current": None})
        if j is not None:
            out.append({"change": "added", "parents": list(b[j][0]), "previous": None, "current": b[j][1]})
    return out


def _change(kind: str, old: dict | None, new: dict | None) -> dict:
    at = new or old
    a, b = old and old["block"], new and new["block"]
    out = {"change": kind, "block_type": at["block"]["type"], "heading_path": [h for _, h in at["path"]], "preceding": at["preceding"], "context_blocks": at["context"], "previous": serialize([a]) if a else None, "current": serialize([b]) if b else None}
    if kind == "modified":
        if a["type"] == "table":
            out["rows"] = table_rows(a, b)
        elif a["type"] == "list":
            out["items"] = list_changes(a, b)
        else:
            out["links_changed"] = a["links"] != b["links"]
    return out


def contextual(previous: list[dict] | None, current: list[dict] | None) -> list[dict] | None:
    """Changes of comparable blocks; None where either side's blocks are missing."""
    if previous is None or current is None:
        return None
    a, b = annotate(previous), annotate(current)
    out = []
    for kind, i, j in aligned([x["key"] for x in a], [x["key"] for x in b]):
        if kind == "pair" and a[i]["block"]["type"] == b[j]["block"]["type"]:
            out.append(_change("modified", a[i], b[j]))
            continue
        if i is not None:
            out.append(_change("deleted", a[i], None))
        if j is not None:
            out.append(_change("added", None, b[j]))
    return out


def _placed(blocks: list[dict]) -> list[tuple]:
    """(type, heading path, block) of comparable blocks."""
    out, path = [], ()
    for b in flat(blocks):
        if b["type"] == "heading":
            path = (*(h for h in path if h[0] < b["level"]), (b["level"], b["text"]))
        elif b["type"] in COMPARED:
            out.append((b["type"], path, b))
    return out


def row_changes(previous: list[dict], current: list[dict]) -> list[dict]:
    """The row changes of `contextual` alone, of its modified tables in order."""
    a, b = _placed(previous), _placed(current)
    if len(a) == len(b) == 1:
        pairs = [(a[0], b[0])] if a != b else []
    else:
        keys = [[(kind, path, canonical(x)) for kind, path, x in side] for side in (a, b)]
        pairs = [(a[i], b[j]) for kind, i, j in aligned(*keys) if kind == "pair"]
    return [r for x, y in pairs if x[0] == y[0] == "table" for r in table_rows(x[2], y[2])]


def state_blocks(previous: list[dict], current: list[dict]) -> list[dict]:
    """Changes of a state's blocks, its cards aligned by title; what is replaced is deleted and added."""

    def parts(blocks):
        cards = [c for b in blocks if b["type"] == "group" for c in b["cards"]]
        return [b for b in blocks if b["type"] != "group"], cards

    (plain_a, cards_a), (plain_b, cards_b) = parts(previous), parts(current)
    out = []
    for kind, i, j in aligned([canonical(x) for x in plain_a], [canonical(x) for x in plain_b]):
        if i is not None:
            out.append({"change": "deleted", "kind": "block", "previous": serialize([plain_a[i]]), "current": None})
        if j is not None:
            out.append({"change": "added", "kind": "block", "previous": None, "current": serialize([plain_b[j]])})
        del kind
    m = difflib.SequenceMatcher(None, [c["title"] for c in cards_a], [c["title"] for c in cards_b], autojunk=False)
    for tag, i1, i2, j1, j2 in m.get_opcodes():
        if tag == "equal":
            pairs = zip(cards_a[i1:i2], cards_b[j1:j2], strict=True)
            out.extend({"change": "modified", "kind": "card", "title": x["title"], "previous": serialize(x["blocks"]), "current": serialize(y["blocks"])} for x, y in pairs if canonical(x) != canonical(y))
        else:
            out.extend({"change": "deleted", "kind": "card", "title": x["title"], "previous": serialize(x["blocks"]), "current": None} for x in cards_a[i1:i2])
            out.extend({"change": "added", "kind": "card", "title": y["title"], "previous": None, "current": serialize(y["blocks"])} for y in cards_b[j1:j2])
    return out
