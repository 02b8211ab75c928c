"""JSON patches: ordered, data-dependent operations, so one document at a time in Arrow batches; all or nothing."""

from __future__ import annotations

import copy
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ABSENT = object()


def tokens_of(pointer: str) -> list[str]:
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise ValueError(f"pointer {pointer!r} doesn't begin with a slash")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/")]


def _index(token: str, size: int) -> int:
    if token == "-":
        return size
    if not token.isdigit() or (len(token) > 1 and token[0] == "0"):
        raise ValueError(f"{token!r} is no array index")
    return int(token)


def _step(node: Any, token: str) -> Any:
    if isinstance(node, list):
        i = _index(token, len(node))
        return node[i] if i < len(node) else _ABSENT
    if isinstance(node, dict):
        return node.get(token, _ABSENT)
    raise ValueError(f"{token!r} isn't in a container")


def get(root: Any, pointer: str) -> Any:
    for token in tokens_of(pointer):
        root = _step(root, token)
    return root


def _put(root: Any, pointer: str, value: Any, replace: bool) -> Any:
    path = tokens_of(pointer)
    if not path:
        return value
    at = root
    for token in path[:-1]:
        at = _step(at, token)
    if isinstance(at, list):
        i = _index(path[-1], len(at))
        if replace:
            if i >= len(at):
                raise ValueError(f"index {i} out of bounds")
            at[i] = value
        else:
            at.insert(i, value)  # beyond the end: at the end
    elif isinstance(at, dict):
        if value is _ABSENT:
            at.pop(path[-1], None)
        else:
            at[path[-1]] = value
    else:
        raise ValueError(f"{path[-1]!r} can't be set here")
    return root


def _take(root: Any, pointer: str) -> Any:
    path = tokens_of(pointer)
    if not path:
        raise ValueError("the root can't be removed")
    at = root
    for token in path[:-1]:
        at = _step(at, token)
    key = _index(path[-1], len(at)) if isinstance(at, list) else path[-1]
    if not isinstance(at, list | dict) or (key >= len(at) if isinstance(at, list) else key not in at):
        raise ValueError(f"{pointer!r} doesn't exist")
    return at.pop(key)


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def apply_operation(root: Any, op: dict) -> Any:
    kind = op.get("op")
    if kind in ("add", "replace"):
        return _put(root, op["path"], copy.deepcopy(op.get("value")), kind == "replace")
    if kind == "remove":
        _take(root, op["path"])
        return root
    if kind in ("move", "copy"):
        if not op.get("from"):
            raise ValueError(f"{kind} needs from")
        value = _take(root, op["from"]) if kind == "move" else get(root, op["from"])
        return _put(root, op["path"], value if value is _ABSENT else copy.deepcopy(value), False)
    if kind == "test":
        if not _same(get(root, op["path"]), op.get("value")):
            raise ValueError("test failed")
        return root
    raise ValueError(f"unknown operation {kind!r}")


def apply_patch(document: str, patch: str) -> tuple[str | None, int | None, str | None]:
    """(patched document, index of the failed operation, why): one or the other."""
    root, i = json.loads(document), 0
    try:
        for i, op in enumerate(json.loads(patch)):
            root = apply_operation(root, op)
    except (ValueError, KeyError, TypeError) as e:
        return None, i, str(e)
    return json.dumps(root, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None, None


def patched(document: Column, patch: Column, target: Column | None = None) -> Column:
    """struct<document, failed_at, message> of JSON texts. target: the id that a patch is for; one of another document is refused whole."""
    if target is not None:
        own = F.get_json_object(document, "$.id")
        wrong = (F.coalesce(target, F.lit("")) != "") & ~target.eqNullSafe(own)
        refused = F.struct(F.lit(None).cast("string").alias("document"), F.lit(None).cast("int").alias("failed_at"), F.concat(F.lit("patch for "), target, F.lit(" doesn't match "), F.coalesce(own, F.lit("a document without id"))).alias("message"))
        return F.when(wrong, refused).otherwise(patched(document, patch))

    @F.pandas_udf("struct<document:string,failed_at:int,message:string>")
    def run(documents: pd.Series, patches: pd.Series) -> pd.DataFrame:
        rows = [apply_patch(d, p) for d, p in zip(documents, patches, strict=True)]
        out = pd.DataFrame(rows, columns=["document", "failed_at", "message"])
        return out.astype({"failed_at": "Int32"})

    return run(document, patch)
