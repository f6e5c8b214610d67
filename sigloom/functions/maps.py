"""Settings as maps from dotted paths to values: nested documents made flat, split by prefix, compared and put back."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _leaves(value: object, path: str, out: dict[str, str]) -> None:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            _leaves(v, f"{path}.{k}" if path else k, out)
    else:
        out[path] = json.dumps(value, ensure_ascii=False, sort_keys=True)


def flattened(document: Column | str) -> Column:
    """Map from the dotted path of each leaf of a JSON object to its JSON text; lists and empty objects are leaves; null for a
    null, broken or non-object document."""

    @pandas_udf("map<string,string>")
    def of(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                value = json.loads(t) if t is not None else None
            except ValueError:
                return None
            if not isinstance(value, dict):
                return None
            out: dict[str, str] = {}
            if value:
                _leaves(value, "", out)
            return out

        return pd.Series([one(t) for t in texts], dtype=object)

    return of(document)


def nested(paths: Column | str) -> Column:
    """The JSON object (keys in order) whose leaves a map holds: the inverse of ``flattened`` for keys without dots."""

    @pandas_udf("string")
    def of(maps: pd.Series) -> pd.Series:
        def one(m):
            if m is None:
                return None
            root: dict = {}
            for path, text in sorted(dict(m).items()):
                *above, last = path.split(".")
                at = root
                for k in above:
                    at = at.setdefault(k, {})
                at[last] = json.loads(text)
            return json.dumps(root, ensure_ascii=False, sort_keys=True)

        return pd.Series([one(m) for m in maps], dtype=object)

    return of(paths)


def under(settings: Column | str, prefix: str) -> Column:
    """The entries below a path, with the path taken off."""
    m = F.col(settings) if isinstance(settings, str) else settings
    return F.transform_keys(F.map_filter(m, lambda k, _: F.startswith(k, F.lit(prefix + "."))), lambda k, _: F.substr(k, F.lit(len(prefix) + 2)))


def outside(settings: Column | str, prefix: str) -> Column:
    """The entries that are not below a path."""
    m = F.col(settings) if isinstance(settings, str) else settings
    return F.map_filter(m, lambda k, _: ~F.startswith(k, F.lit(prefix + ".")))


def rooted(settings: Column | str, prefix: str) -> Column:
    m = F.col(settings) if isinstance(settings, str) else settings
    return F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix + "."), k))


def changed(settings: Column | str, base: Column | str) -> Column:
    """The entries of ``settings`` that ``base`` lacks or has otherwise."""
    m, b = (F.col(c) if isinstance(c, str) else c for c in (settings, base))
    return F.map_filter(m, lambda k, v: ~F.element_at(b, k).eqNullSafe(v))


def overlaid(base: Column | str, over: Column | str) -> Column:
    """``base`` with the entries of ``over`` put over its own."""
    b, o = (F.col(c) if isinstance(c, str) else c for c in (base, over))
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(o, k)), o)
