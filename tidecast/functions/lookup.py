"""Look-ups in tables that travel in the plan."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_map(entries: dict) -> tuple[Column, int]:
    """An array of small maps, an entry's map being picked by its key's hash: a look-up reads one or two
    entries, however many there are (a map look-up is a scan of the map)."""
    n = max(1, len(entries))
    slots: list[list] = [[] for _ in range(n)]
    for k, v in entries.items():
        slots[zlib.crc32(k.encode("utf-8")) % n].append((k, v))
    empty = F.lit(None).cast("map<string,string>")
    maps = [F.create_map(*[F.lit(x) for kv in s for x in kv]) if s else empty for s in slots]
    return F.array(*maps), n


def look_up(table: tuple[Column, int], key: Column) -> Column:
    maps, n = table
    return F.element_at(F.get(maps, F.pmod(F.crc32(key.cast("binary")), F.lit(n)).cast("int")), key)
