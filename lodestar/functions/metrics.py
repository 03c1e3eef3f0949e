"""Text and payload metrics: column expressions for tables, driver functions for one bundle."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import SPACE

CJK = "[㐀-䶿一-鿿豈-﫿]"


def _count(text: Column, pattern: str) -> Column:
    """Characters that match the class ``pattern``, removed run by run."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def _ceil(x: Column) -> Column:
    return F.ceil(x).cast("long")


def estimate_tokens(text: Column) -> Column:
    """A quarter of ASCII word characters, half of ASCII punctuation, every CJK character, half of the rest; each rounded up."""
    t = F.coalesce(text, F.lit(""))
    solid = F.regexp_replace(t, f"(?U){SPACE}+", "")
    word = _count(solid, "[A-Za-z0-9_]")
    ascii_ = _count(solid, r"[\x00-\x7F]")
    cjk = _count(solid, CJK)
    other = F.length(solid) - ascii_ - cjk
    return _ceil(word / 4) + _ceil((ascii_ - word) / 2) + cjk.cast("long") + _ceil(other / 2)


def text_metrics(text: Column) -> dict[str, Column]:
    """The eight metrics of a text, null like the empty text."""
    t = F.coalesce(text, F.lit(""))
    ascii_ = _count(t, r"[\x00-\x7F]")
    trimmed = F.regexp_replace(t, f"(?U)^{SPACE}+|{SPACE}+$", "")
    return {
        "chars": F.length(t).cast("long"),
        "utf8_bytes": F.octet_length(t).cast("long"),
        "ascii_chars": ascii_.cast("long"),
        "non_ascii_chars": (F.length(t) - ascii_).cast("long"),
        "cjk_chars": _count(t, CJK).cast("long"),
        "lines": F.when(t == "", 0).otherwise(_count(t, "\n") + 1).cast("long"),
        "whitespace_terms": F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"(?U){SPACE}+"))).cast("long"),
        "estimated_tokens": estimate_tokens(t),
    }


def collection_summary(df: DataFrame, text_col: str) -> DataFrame:
    """One row: count, totals, averages (3 decimals) and maximum over a column of texts; zeros if there is none."""
    m = text_metrics(F.col(text_col))
    n = F.count("*")
    zero = F.lit(0).cast("long")

    def average(x: Column) -> Column:
        return F.coalesce(F.round(F.sum(x) / F.nullif(n, F.lit(0)), 3), F.lit(0.0))

    return df.agg(
        n.alias("count"),
        F.coalesce(F.sum(m["chars"]), zero).alias("chars_total"),
        average(m["chars"]).alias("chars_avg"),
        F.coalesce(F.max(m["chars"]), zero).alias("chars_max"),
        F.coalesce(F.sum(m["utf8_bytes"]), zero).alias("utf8_bytes_total"),
        F.coalesce(F.sum(m["estimated_tokens"]), zero).alias("estimated_tokens_total"),
        average(m["estimated_tokens"]).alias("estimated_tokens_avg"),
    )


def count_by_key(df: DataFrame, key: str) -> DataFrame:
    """(bucket, n): rows for each value as text; null counts as ``None``."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("None")).alias("bucket")).agg(F.count("*").alias("n"))


# --- one value on the driver -------------------------------------------------------------


def local_text_metrics(value: Any) -> dict[str, int]:
    """:func:`text_metrics` of a single value that is on the driver already."""
    text = "" if value is None else str(value)
    kinds = {"word": 0, "punctuation": 0, "cjk": 0, "other": 0, "ascii": 0, "cjk_all": 0}
    for ch in text:
        cjk = any(low <= ch <= high for low, high in (("㐀", "䶿"), ("一", "鿿"), ("豈", "﫿")))
        kinds["ascii"] += ch.isascii()
        kinds["cjk_all"] += cjk
        if not ch.isspace():
            kinds["word" if ch.isascii() and (ch.isalnum() or ch == "_") else "punctuation" if ch.isascii() else "cjk" if cjk else "other"] += 1
    return {
        "chars": len(text),
        "utf8_bytes": len(text.encode("utf-8", "surrogatepass")),
        "ascii_chars": kinds["ascii"],
        "non_ascii_chars": len(text) - kinds["ascii"],
        "cjk_chars": kinds["cjk_all"],
        "lines": text.count("\n") + 1 if text else 0,
        "whitespace_terms": len(text.split()),
        "estimated_tokens": -(-kinds["word"] // 4) + -(-kinds["punctuation"] // 2) + kinds["cjk"] + -(-kinds["other"] // 2),
    }


def json_payload(payload: Any) -> str:
    """Compact JSON with sorted keys; what JSON lacks is written as text."""
    return json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def structure_metrics(payload: Any) -> dict[str, int]:
    counts = {"dict_nodes": 0, "list_nodes": 0, "leaf_nodes": 0}
    todo: list[Any] = [payload]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            counts["dict_nodes"] += 1
            todo += x.values()
        elif isinstance(x, (list, tuple, set)):
            counts["list_nodes"] += 1
            todo += x
        else:
            counts["leaf_nodes"] += 1
    return counts


def payload_metrics(payload: Any) -> dict[str, Any]:
    """Text metrics of the serialised payload, its top-level type and size, and its node counts."""
    size = len(payload) if hasattr(payload, "__len__") else None
    return local_text_metrics(json_payload(payload)) | {"top_level_type": type(payload).__name__, "top_level_size": size} | structure_metrics(payload)


def local_collection_summary(texts: Iterable[str]) -> dict[str, Any]:
    every = [local_text_metrics(t) for t in texts]
    total = {k: sum(m[k] for m in every) for k in ("chars", "utf8_bytes", "estimated_tokens")}
    n = len(every)
    return {
        "count": n,
        "chars_total": total["chars"],
        "chars_avg": round(total["chars"] / n, 3) if n else 0.0,
        "chars_max": max((m["chars"] for m in every), default=0),
        "utf8_bytes_total": total["utf8_bytes"],
        "estimated_tokens_total": total["estimated_tokens"],
        "estimated_tokens_avg": round(total["estimated_tokens"] / n, 3) if n else 0.0,
    }
