"""State machines of a few states as function tables: native, and a key's events need not be in one task.

A transition (machines.py) over a few states and symbols is a table: of each symbol, the next state of every state.
Tables compose, and composition is associative.  So the events of a key are cut into chunks of its order; each chunk is
one composed table, made on its own; the tables of a key's chunks are composed from the left, in blocks and then over
blocks, which gives the state that each chunk starts in; with it each chunk gives its outputs, again on its own.  What meets
in one place is a table a chunk, not the events: a key with a third of all events is as many chunks as it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .machines import Transition


@dataclass(frozen=True)
class Machine:
    """next and output by symbol x number of states + state; state 0 is the start."""

    symbols: tuple[str, ...]
    states: int
    next: tuple[int, ...]
    output: tuple[str | None, ...]


def compiled(transition: Transition, symbols: dict[str, dict]) -> Machine:
    """The table of a transition over these events, for the states that can be reached from the empty one."""
    states, steps = [{}], {}
    for state in states:  # grows
        for name, event in symbols.items():
            new, out = transition(dict(state), dict(event))
            if new not in states:
                states.append(new)
            steps[name, states.index(state)] = states.index(new), out
    flat = [steps[name, i] for name in symbols for i in range(len(states))]
    return Machine(tuple(symbols), len(states), tuple(n for n, _ in flat), tuple(o for _, o in flat))


def run(events: DataFrame, key: str, order: str, symbol: Column, machine: Machine, span: int = 1024, block: int = 4096) -> DataFrame:
    """(key, order, output) of the events with an output.

    order: a whole number or a timestamp that puts a key's events in order (equal ones in order of their symbols); a chunk
    is `span` of its units, `block` chunks are composed at a time.  Events without key, order or symbol do nothing.
    """
    n = machine.states
    kind = events.schema[order].dataType
    place = F.unix_micros(F.col(order).cast("timestamp")) if "timestamp" in kind.simpleString() else F.col(order).cast("long")
    number = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(machine.symbols) for x in (s, i)]), symbol)
    following, outputs = F.array(*map(F.lit, machine.next)), F.array(*[F.lit(o).cast("string") for o in machine.output])
    after = lambda s, e: F.get(following, e.symbol * n + s)
    then = lambda f, g: F.transform(f, lambda s: F.get(g, s))  # noqa: E731  f, and after it g
    same = F.array(*map(F.lit, range(n)))

    rows = events.select(F.col(key).alias("key"), place.alias("place"), F.col(order).alias("order"), number.alias("symbol")).dropna()
    chunks = rows.groupBy("key", F.floor(F.col("place") / span).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "symbol", "order"))).alias("events"))
    tables = chunks.select("key", "chunk", F.aggregate("events", same, lambda f, e: F.transform(f, lambda s: after(s, e))).alias("f"))

    # from the left within blocks of a key's chunks, then over its blocks
    rank = F.row_number().over(Window.partitionBy("key").orderBy("chunk")) - 1
    listed = lambda at, f: F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(f).alias("f"))))
    begin = F.struct(same.alias("now"), F.array().cast("array<struct<at:bigint,f:array<int>>>").alias("seen"))
    scanned = lambda c: F.aggregate(c, begin, lambda s, x: F.struct(then(s.now, x.f).alias("now"), F.array_append(s.seen, F.struct(x.at.alias("at"), s.now.alias("f"))).alias("seen")))
    blocks = tables.withColumn("block", F.floor(rank / block)).groupBy("key", "block").agg(listed("chunk", "f").alias("c")).select("key", "block", scanned(F.col("c")).alias("s"))
    whole = blocks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("block").alias("at"), F.col("s.now").alias("f")))).alias("c")).select("key", F.explode(scanned(F.col("c")).seen).alias("b")).select("key", F.col("b.at").alias("block"), F.get("b.f", F.lit(0)).alias("start"))
    starts = blocks.select("key", "block", F.explode("s.seen").alias("c")).join(whole, ["key", "block"]).select("key", F.col("c.at").alias("chunk"), F.get("c.f", F.col("start")).alias("state"))

    made = events.schema[order].dataType.simpleString()
    first = F.struct(F.col("state"), F.array().cast(f"array<struct<order:{made},output:string>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        said = F.get(outputs, e.symbol * n + s.state)
        return F.struct(after(s.state, e).alias("state"), F.when(said.isNull(), s.out).otherwise(F.array_append(s.out, F.struct(e.order.alias("order"), said.alias("output")))).alias("out"))

    told = chunks.join(starts, ["key", "chunk"]).select("key", F.explode(F.aggregate("events", first, step).out).alias("o"))
    return told.select(F.col("key").alias(key), F.col("o.order").alias(order), F.col("o.output").alias("output"))
