"""Links from lists of candidates, in rounds, without all pairs of a list.

A list is the rows that share a token. Each round compares some members (pivots) of each list
with the later ones, only where their components still differ; linked members become one
component. A list is done when it is one component or when each of its members has been a pivot.
So every link between two components is found, and a long list of copies costs one comparison
for each copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tasks_for
from .components import components


def numbered(lists: DataFrame) -> DataFrame:
    """Adds rn, the place of each row in its list (columns token, cls)."""
    return lists.withColumn("rn", F.row_number().over(Window.partitionBy("token").orderBy("cls")))


def collapsed(index: DataFrame, attrs: list[str], least: list[str], two: str = "true") -> DataFrame:
    """Lists of two and more members from rows (token, cls, attrs, least); lists with the same members become one.

    The one list has, of each member, the smallest values of ``least``. ``two`` is a condition on
    the smallest and largest attrs (x1, x2 for attr x) of a list of two: without it the list goes.
    """
    by = Window.partitionBy("token")
    held = index.withColumns({"_n": F.count("*").over(by), "_x": F.bit_xor(F.xxhash64("cls")).over(by), "_m": F.min("cls").over(by)})
    if two != "true":
        held = held.withColumns({f"{x}{i}": f(x).over(by) for x in attrs for i, f in ((1, F.min), (2, F.max))}).filter(f"_n > 2 OR ({two})")
    held = held.filter("_n > 1").select(F.xxhash64("_n", "_x", "_m").alias("token"), "cls", *attrs, *least)
    return held.groupBy("token", "cls").agg(*[F.first(x).alias(x) for x in attrs], *[F.min(x).alias(x) for x in least])


def connect(lists: DataFrame, attrs: list[str], keep: str, test: Callable[[DataFrame], DataFrame], scratch: Scratch, steps: tuple[int, ...] = (1, 8), marks: DataFrame | None = None, near: str = "true") -> DataFrame | None:
    """(id, component) of all ids that links join, or None without links.

    ``lists`` has token, cls, rn and ``attrs``; ``keep`` is an SQL condition on attrs of two
    members (x1, x2 for attr x) that pairs must meet; ``test`` turns (a, b) into (a, b, linked).
    ``marks`` has more columns of cls, and ``near`` a condition on them, for rounds after the first.
    The number of pivots of a list is ``steps`` and then four times the one before.
    """
    labels, failed, low, n = None, None, 1, 0
    while True:
        step = steps[n] if n < len(steps) else step * 4  # noqa: F821
        n += 1
        pairs = _pairs(lists, attrs, keep, labels, low, low + step, marks, near)
        if failed is not None:
            pairs = pairs.join(failed, ["a", "b"], "leftanti")
        tested = scratch.keep(test(pairs), "tested")
        with tasks_for(scratch.spark, scratch.rows["tested"]):
            links = tested.filter("linked").select("a", "b")
            no = tested.filter("NOT linked").select("a", "b")
            failed = no if failed is None else failed.union(no)
            if not links.isEmpty():
                if labels is not None:
                    at = lambda side: F.coalesce(F.col(f"c{side}"), F.col(side)).alias(side)
                    links = links.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left").select(at("a"), at("b"))
                new = components(links, scratch)
                if labels is not None:
                    moved = labels.join(new.toDF("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
                    new = scratch.keep(moved.union(new.join(labels.select("id"), "id", "leftanti")), "labels")
                labels = new
        low += step
        scratch.release()
        lists = scratch.keep(_open(lists, labels, low), "lists")
        if not scratch.rows["lists"]:
            return labels


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("label", F.col("cls"))
    return lists.join(labels.toDF("cls", "component"), "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")


def _open(lists: DataFrame, labels: DataFrame | None, low: int) -> DataFrame:
    """The lists of more than one component that have members from ``low`` on to compare with later ones."""
    held = _labelled(lists, labels)
    state = held.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("rn").alias("last"))
    return lists.join(state.filter((F.col("x") != F.col("y")) & (F.col("last") > low)).select("token"), "token", "leftsemi")


def _pairs(lists: DataFrame, attrs: list[str], keep: str, labels: DataFrame | None, low: int, high: int, marks: DataFrame | None = None, near: str = "true") -> DataFrame:
    """Pairs of a member from ``low`` to below ``high`` with a later one of another component."""
    if (low, high) == (1, 2):
        first = F.first(F.struct("cls", *attrs)).over(Window.partitionBy("token").orderBy("rn"))
        both = lists.withColumn("p", first).filter("rn > 1")
        pairs = both.select(F.col("p.cls").alias("c1"), *[F.col(f"p.{x}").alias(f"{x}1") for x in attrs], F.col("cls").alias("c2"), *[F.col(x).alias(f"{x}2") for x in attrs]).filter(keep)
    else:
        held = _labelled(lists, labels)
        if marks is not None:
            held, attrs, keep = held.join(marks, "cls"), [*attrs, *[c for c in marks.columns if c != "cls"]], f"({keep}) AND {near}"
        side = lambda i: [F.col(x).alias(f"{x}{i}") for x in (*attrs, "rn", "label", "token")] + [F.col("cls").alias(f"c{i}")]
        one = held.filter((F.col("rn") >= low) & (F.col("rn") < high)).select(*side(1))
        pairs = one.join(held.select(*side(2)), F.expr(f"token1 = token2 AND rn2 > rn1 AND label1 <> label2 AND ({keep})"))
    return pairs.filter("c1 <> c2").select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).distinct()
