"""Versions of facts that arrive late, from state that is read and written only at the places that a batch touches.

Most keys have few facts, and a call of the store costs more than to read them. So keys are dealt over BUCKETS pages by hash:
a page holds the event orders of its keys of at most SHORT orders, and is read and written once a batch.

The event orders of a longer key are a radix tree in a map state: eight levels of a byte each, a node being the set of its
children that exist. A fact's neighbours are found by reading one path up and one down, at most sixteen nodes of at most 32
bytes, however long the key's history is, and a fact adds or changes at most eight nodes and one leaf.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

LEVELS = 8
#: Event orders of a key that stand in its page; more make a tree.
SHORT = 32
#: Pages of a stream; a stream that goes on from its log needs the number that it began with.
BUCKETS = 1 << 14
LEAST = -(1 << 63)
VERSIONS = "fact_id long, version long, predecessor_id long, successor_id long"
VERSION = Row("fact_id", "version", "predecessor_id", "successor_id")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def store_of_keys(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store that reads single keys; the session's choice returns afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Orders:
    """The event orders of a long key, over its map states; what a batch reads or writes is kept until it is stored."""

    def __init__(self, key: str, nodes: MapState, leaves: MapState) -> None:
        self.key, self.nodes, self.leaves = key, nodes, leaves
        self.children: dict[tuple[int, int], int] = {}
        self.facts: dict[int, tuple[int, int] | None] = {}
        self.changed: set[tuple[int, int]] = set()
        self.changed_facts: set[int] = set()

    def node(self, level: int, path: int) -> int:
        """The children of a node as the bits of a number, 0 if there is none."""
        at = (level, path)
        if at not in self.children:
            absent = level and not self.node(level - 1, path >> 8) >> (path & 255) & 1  # needs no read
            found = None if absent else self.nodes.getValue((self.key, *at))
            self.children[at] = int.from_bytes(found[0], "little") if found else 0
        return self.children[at]

    def ends(self, place: int) -> tuple[int, int] | None:
        """First and last fact of an event order."""
        if place not in self.facts:
            there = self.node(LEVELS - 1, place >> 8) >> (place & 255) & 1
            found = self.leaves.getValue((self.key, place + LEAST)) if there else None
            self.facts[place] = tuple(found) if found else None
        return self.facts[place]

    def beside(self, place: int, after: bool) -> int | None:
        """The nearest event order strictly after (or before) ``place``."""
        for level in range(LEVELS - 1, -1, -1):
            path = place >> 8 * (LEVELS - level)
            child = place >> 8 * (LEVELS - 1 - level) & 255
            bits = self.node(level, path)
            bits = bits >> child + 1 << child + 1 if after else bits & (1 << child) - 1
            if bits:
                path = path << 8 | _end(bits, after)
                for below in range(level + 1, LEVELS):
                    path = path << 8 | _end(self.node(below, path), after)
                return path
        return None

    def add(self, order: int, fact: int) -> tuple[int | None, int | None]:
        """Put a fact in its place, after those of the same order; gives the facts before and after it."""
        place = order - LEAST
        same, before, after = self.ends(place), None, self.beside(place, True)
        if same is None:
            before = self.beside(place, False)
        self.put(order, (same[0] if same else fact, fact))
        prior = same[1] if same else self.ends(before)[1] if before is not None else None
        return prior, self.ends(after)[0] if after is not None else None

    def put(self, order: int, ends: tuple[int, int]) -> None:
        """Set the first and last fact of an event order."""
        place = order - LEAST
        for level in range(LEVELS - 1, -1, -1):
            at, bit = (level, place >> 8 * (LEVELS - level)), 1 << (place >> 8 * (LEVELS - 1 - level) & 255)
            had = self.node(*at)
            if had & bit:
                break
            self.children[at] = had | bit
            self.changed.add(at)
        self.facts[place] = ends
        self.changed_facts.add(place)

    def store(self) -> None:
        for at in self.changed:
            bits = self.children[at]
            self.nodes.updateValue((self.key, *at), (bits.to_bytes((bits.bit_length() + 7) // 8, "little"),))
        for place in self.changed_facts:
            self.leaves.updateValue((self.key, place + LEAST), self.facts[place])


def _end(bits: int, least: bool) -> int:
    return (bits & -bits).bit_length() - 1 if least else bits.bit_length() - 1


def add_short(held: list, order: int, fact: int) -> tuple[int | None, int | None]:
    """As ``Orders.add``, of a key in its page: ``held`` has event orders in order, their first and their last facts."""
    orders, firsts, lasts = held
    at, after = bisect_left(orders, order), bisect_right(orders, order)
    prior, later = (lasts[after - 1] if after else None), (firsts[after] if after < len(orders) else None)
    if at < after:
        lasts[at] = fact
    else:
        for values, value in ((orders, order), (firsts, fact), (lasts, fact)):
            values.insert(at, value)
    return prior, later


class Versions(StatefulProcessor):
    """Numbers the facts of each key of a bucket as they come and names their neighbours in event order among those that came before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        #: For each key how many facts it had and its orders, or null for a long key, whose number stands in ``seen``.
        self.page = handle.getValueState("page", "keys string")
        self.seen = handle.getMapState("seen", "key string", "n long")
        self.nodes = handle.getMapState("nodes", "key string, level int, path long", "children binary")
        self.leaves = handle.getMapState("leaves", "key string, event_order long", "first_id long, last_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        found = self.page.get()
        page, changed = json.loads(found[0]) if found else {}, False
        facts = sorted((r[1], r[4], r[2], r[3]) for r in rows)
        for name, mine in groupby(facts, key=lambda f: f[0]):
            n, held = page.get(name) or (0, [[], [], []])
            tree = None
            if held is None:
                n, tree = self.seen.getValue((name,))[0], Orders(name, self.nodes, self.leaves)
            for _, _, fact, order in mine:
                n += 1
                yield VERSION(fact, n, *(add_short(held, order, fact) if tree is None else tree.add(order, fact)))
                if tree is None and len(held[0]) > SHORT:
                    tree = Orders(name, self.nodes, self.leaves)
                    for at, *ends in zip(*held, strict=True):
                        tree.put(at, tuple(ends))
            if tree is None:
                page[name], changed = (n, held), True
            else:
                tree.store()
                self.seen.updateValue((name,), (n,))
                if held is not None:
                    page[name], changed = (n, None), True
        if changed:
            self.page.update((json.dumps(page, separators=(",", ":")),))

    def close(self) -> None:
        pass


def key_text(stream: DataFrame, keys: list[str]) -> Column:
    """Key columns of plain types as one text, nulls apart from texts."""
    plain = [F.col(k) + 0.0 if stream.schema[k].dataType.typeName() in ("float", "double") else F.col(k) for k in keys]
    return F.to_json(F.array(*[c.cast("string") for c in plain]))


def late_versions(stream: DataFrame, keys: list[str]) -> DataFrame:
    """(fact_id, version, predecessor_id, successor_id) of facts (fact_id, event_order, ingest_seq) that may arrive late.

    A fact goes between its neighbours and never takes the place of a later one. Facts of one event order stand as they came;
    facts of a batch come in ingest order, ties by fact_id. A null event order is the earliest of all, a null ingest number the
    first of its batch; a null fact_id is left out; null key columns make a key, of plain types. Other columns do not matter. A
    batch's new facts of one bucket are in memory, so a trigger's bound on files bounds them, and its page; the history of long
    keys is not. Start the query inside ``store_of_keys``.
    """
    least = F.lit(LEAST)
    name = key_text(stream, keys)
    cleaned = stream.filter("fact_id is not null").select(F.pmod(F.xxhash64(name), F.lit(BUCKETS)).alias("bucket"), name.alias("key"), F.col("fact_id").cast("long").alias("fact_id"), F.coalesce(F.col("event_order").cast("long"), least).alias("event_order"), F.coalesce(F.col("ingest_seq").cast("long"), least).alias("ingest_seq"))
    return cleaned.groupBy("bucket").transformWithState(Versions(), VERSIONS, "append", "none")
