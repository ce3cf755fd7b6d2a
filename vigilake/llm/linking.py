"""Links within candidate groups, without all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import rows_of
from .common import Stages
from .components import connected_components

PARTS = 64  # parts that the pairs of one center are dealt into, so that no center is one task's
COMMON = 1_000  # changes around a center that are told to be common (an order only; links are the same)
CROWD = 16  # groups of no more pairs across components for each of their members are settled by these (the plan only; links are the same)


class Linker:
    """Components of the sets that link, sought within groups of candidates.

    ``members`` are (grp, key, size, rank), ``facts`` (key, size, ...) of each key, ``sets(keys)``
    gives (key, held), from which ``elements(held)`` makes the elements of whole sets, repeats or not (what
    is small is shuffled, and sets are made where pairs meet); ``bound(x, y)`` is a lower bound of
    the number of elements in which two sets differ, on the columns of ``facts`` with two prefixes.
    Two sets of one group link when intersection * 100 >= union * ``percent``.

    In a round each group has one center, of least rank, and its other members meet the center
    alone; groups of one center are one group from then on. Groups that then stand in one component are
    done, and those of few pairs across components, for each of their members, wait for the end. With c
    the center of a crowded one and D(x) the elements in which x and c differ, x links with c when D(x)
    is small enough; and of two sets that link, but not both with c, the sets D share
    (|D(x)| + |D(y)| - most differing) / 2 elements at least, one in any case. So members near c are
    grouped anew by elements of D that another member's D has too, of its first ones in one order, as many as
    the bound asks for, the common ones last: a crowd of near copies falls apart into those that share
    changes, and members whose own, unshared changes are too many for any link leave. Members far from c stay together without
    it; the triangle inequality puts each pair that may link into one of the two. The next round takes
    what is still crowded. At the end all pairs of what is left in several components are compared,
    where the bounds allow a link, so no link of a group is lost.
    """

    def __init__(
        self,
        stages: Stages,
        percent: int,
        facts: DataFrame,
        bound: Callable[[str, str], Column],
        sets: Callable[[DataFrame], DataFrame],
        elements: Callable[[Column], Column] = lambda held: held,
        rounds: int = 3,
    ):
        self.stages, self.percent, self.facts, self.bound, self.sets, self.elements, self.rounds = stages, percent, facts, bound, sets, elements, rounds
        # near means within so many times the most that a link allows (some 4/3 of a set's size), far means beyond a little less
        self.shell = max(1 + -(-200 // percent), -(-4 * percent // (3 * (100 - percent)))) if percent < 100 else 3
        self.beyond = (self.shell - 1) * percent / 100
        self.per = (100 - percent) / (100 + percent)  # linked sets differ in so large a share of their sizes' sum at most

    def most(self, size: Column) -> Column:
        """The elements in which a set of this size may differ from one it links with."""
        return size * (100 - self.percent) / self.percent

    def at(self, pairs: DataFrame, of: DataFrame, on: str, prefix: str, how: str = "inner") -> DataFrame:
        """``pairs`` (c, key) with the columns of ``of`` for one side, a center's pairs in parts."""
        columns = [F.col(n).alias(f"{prefix}{n}") for n in of.columns if n != "key"]
        of = of.select(F.col("key").alias(on), *columns)
        if on == "key":
            return pairs.join(of, "key")
        part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).alias("part")
        needed = pairs.select("c", part).distinct().join(of, "c")
        return pairs.select("*", part).join(needed, ["c", "part"], how).drop("part")

    def differences(self, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(c, key, c_size, size, e) for the pairs (c, key, wide) that may be near, or link, e being in how many elements they
        differ; and the sets (key, held) of these."""
        met = self.at(self.at(pairs, self.facts, "key", "x_"), self.facts, "c", "y_")
        reach = F.when(F.col("wide"), F.lit(self.shell)).otherwise(F.lit(1)) * self.most(F.col("x_size"))
        near = met.where(self.bound("x_", "y_") <= reach).select("c", "key", F.col("y_size").alias("c_size"), F.col("x_size").alias("size"))
        near = self.stages.save(near, f"near_{name}", rows_of(pairs))
        keys = self.stages.save(near.select("key").union(near.select("c")).distinct(), f"keys_{name}", 2 * rows_of(near))
        sets = self.stages.save(self.sets(keys), f"sets_{name}")
        both = self.at(self.at(near, sets, "key", "x_"), sets, "c", "y_")
        shared = F.size(F.array_intersect(self.elements(F.col("x_held")), self.elements(F.col("y_held"))))
        # written as it is made: a filter on it would compare the sets once more
        made = self.stages.save(both.select("c", "key", "c_size", "size", (F.col("c_size") + F.col("size") - 2 * shared).cast("long").alias("e")), f"differing_{name}")
        self.stages.drop(near, keys)
        return made, sets

    def links(self, members: DataFrame) -> DataFrame:
        """Pairs (a, b) that link, with the same components as all pairs that do."""
        if members.isEmpty():
            return members.select(F.col("key").alias("a"), F.col("key").alias("b"))
        links: DataFrame | None = None
        roots: DataFrame | None = None
        n_members = rows_of(members)
        waiting = []
        for r in range(self.rounds):
            center = F.min(F.struct("rank", F.xxhash64("key").alias("tie"), "key")).alias("c")
            centers = members.groupBy("grp").agg(center).select("grp", F.col("c.key").alias("c"))
            # groups of one center are one from here on: copies meet in many groups, and most of these have the same
            met = members.join(centers, "grp").where("key <> c").groupBy("c", "key").agg(F.first("size").alias("size"), F.min("rank").alias("rank"))
            met = self.stages.save(met, f"met_{r}", n_members)
            sizes = met.groupBy(F.col("c").alias("key")).agg((F.count("*") > CROWD).alias("wide")).where("wide")
            wide = self.at(met.select("c", "key"), sizes, "c", "", "left").select("c", "key", F.coalesce("wide", F.lit(False)).alias("wide"))
            differing, sets = self.differences(self.stages.save(wide, f"pairs_{r}", rows_of(met)), str(r))
            linked = self.linked(differing)
            links = linked if links is None else links.union(linked)
            # stars of the round before stand for its links
            stars = linked if roots is None else linked.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = connected_components(stars, self.stages)
            left = self.stages.save(self._mixed(met.withColumn("grp", F.xxhash64("c")), roots), f"left_{r}", rows_of(met))
            # x and y differ by |e(x) - e(y)| at least, e being counted from their center; of a set too far for it, all may be shared
            e = F.coalesce("e", F.lit(0).cast("long")), F.coalesce("e", F.lit(1 << 40))
            settled = left.where("few").join(differing.select("c", "key", "e"), ["c", "key"], "left")
            waiting.append(settled.select("grp", "key", "size", e[0].alias("e"), e[1].alias("q")))
            self.stages.drop(met)
            crowded = left.where("not few")
            if crowded.isEmpty():
                self.stages.drop(sets)
                break
            again = self.regrouped(crowded, differing, sets, r)
            again = self.stages.save(again, f"regrouped_{r}")
            self.stages.drop(sets)
            again = self.stages.save(self._mixed(again, roots), f"members_{r}", rows_of(again))
            waiting.append(again.where("few").select("grp", "key", "size", "e", "q"))
            members, n_members = again.where("not few").select("grp", "key", "size", "rank", "e", "q"), rows_of(again)
            if members.isEmpty():
                break
        else:
            waiting.append(members.select("grp", "key", "size", "e", "q"))
        here = waiting[0]
        for w in waiting[1:]:
            here = here.union(w)
        here = self.stages.save(self._mixed(here, roots), "last")
        if here.isEmpty():
            return links
        sides = [here.select("grp", *(F.col(c).alias(f"{p}_{c}") for c in ("key", "size", "comp", "e", "q"))) for p in "xy"]
        fit = F.least("x_size", "y_size") * 100 >= F.greatest("x_size", "y_size") * self.percent
        shared = F.col("x_e") + F.col("y_e") - (F.col("x_size") + F.col("y_size")) * self.per - 1e-6 <= 2 * F.least("x_q", "y_q")
        pairs = sides[0].join(sides[1], "grp").where((F.col("x_comp") < F.col("y_comp")) & fit & shared)
        pairs = pairs.select(F.col("x_key").alias("c"), F.col("y_key").alias("key"), F.lit(False).alias("wide")).distinct()
        differing, sets = self.differences(self.stages.save(pairs, "last_pairs"), "last")
        self.stages.drop(sets)
        return links.union(self.linked(differing))

    def linked(self, differing: DataFrame) -> DataFrame:
        """The pairs (a, b) that link: union = (sizes + differing) / 2."""
        close = F.col("e") * (100 + self.percent) <= (F.col("size") + F.col("c_size")) * (100 - self.percent)
        return differing.where(close).select(F.col("c").alias("a"), F.col("key").alias("b"))

    def regrouped(self, left: DataFrame, differing: DataFrame, sets: DataFrame, r: int) -> DataFrame:
        """The next (grp, key, size, rank, e, q) for ``left`` (grp, key, size, rank, c, comp)."""
        largest = left.groupBy("c", "comp").agg(F.count("*").alias("k")).groupBy(F.col("c").alias("key")).agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"))
        near = self.at(left.select("c", "key", "rank", "comp"), largest, "c", "").withColumn("outside", F.col("comp") != F.col("largest"))
        near = near.join(differing, ["c", "key"]).where(F.col("e") <= self.shell * self.most(F.col("size")))
        both = self.at(self.at(near, sets, "key", "x_"), sets, "c", "y_")
        both = both.withColumns({f"{p}elements": self.elements(F.col(f"{p}held")) for p in ("x_", "y_")})
        delta = F.concat(F.array_except("x_elements", "y_elements"), F.array_except("y_elements", "x_elements"))
        near = self.stages.save(both.select("c", "key", "c_size", "size", "rank", "comp", "outside", delta.alias("delta")), f"around_{r}")
        within = differing.where(F.col("e") <= self.beyond * self.most(F.col("size"))).select("c", "key")
        far = left.join(within, ["c", "key"], "left_anti")
        far = far.select(F.xxhash64("c").alias("grp"), "key", "size", "rank", F.lit(0).cast("long").alias("e"), F.lit(1 << 40).alias("q"))
        return self.by_changes(near, r).unionByName(far)

    def by_changes(self, near: DataFrame, r: int) -> DataFrame:
        """Members near their center, by the elements of their differences that others share.

        Two sets that link differ in ``most`` elements at most, and so do their D: in any one order the first element that
        both have is among the first ``most`` + 1 of either. Only these are dealt out, the changes that are
        common around a center last. What is common is counted over the members with few changes, and only orders."""
        cell = F.floor(F.log1p(F.size("delta")) * 8).alias("e_cell")
        near = near.select("c", "key", "c_size", "size", "rank", "comp", "outside", F.size("delta").cast("long").alias("e"), cell, "delta")
        # members alike in numbers of changes are one cell, those of the largest component, which only meet others, cells of
        # their own; cells that allow no link with any other drop out
        cells = near.groupBy("c", "e_cell", "outside").agg(
            F.min("e").alias("e"), F.max("e").alias("q"), F.max("size").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
        )
        cells = self.stages.save(cells, f"cells_{r}")
        i, j = (cells.select("c", *(F.col(n).alias(f"{p}_{n}") for n in cells.columns if n != "c")) for p in "ij")
        met = i.join(j, "c").where((F.least("i_lo", "j_lo") < F.greatest("i_hi", "j_hi")))
        least = F.ceil((F.col("i_e") + F.col("j_e") - (F.col("i_size") + F.col("j_size")) * self.per - 1e-6) / 2)
        open_ = met.where(F.greatest(least, F.lit(1)) <= F.least("i_q", "j_q"))
        open_ = open_.groupBy("c", F.col("i_e_cell").alias("e_cell"), F.col("i_outside").alias("outside")).agg(F.min(F.col("j_e") - F.col("j_size") * self.per).alias("other"))

        close = near.where(F.col("e") <= 2 * self.most(F.col("size")) + 2)
        often = close.select("c", F.explode("delta").alias("u")).groupBy("c", "u").agg(F.count("*").alias("k")).where("k > 1")
        ranked = F.reverse(F.slice(F.sort_array(F.collect_list(F.struct("k", "u")), asc=False), 1, COMMON))
        common = cells.select("c").distinct().join(often, "c", "left").groupBy("c").agg(F.transform(F.filter(ranked, lambda s: s["u"].isNotNull()), lambda s: s["u"]).alias("common"))
        common = self.stages.save(common.select(F.col("c").alias("key"), "common"), f"common_{r}")

        x = self.at(near.join(open_, ["c", "e_cell", "outside"]), common, "c", "")
        least = F.greatest(F.ceil((F.col("e") - F.col("size") * self.per + F.col("other") - 1e-6) / 2), F.lit(1))
        x = x.where(least <= F.col("e"))
        first = F.least(F.col("e") - least, F.floor(self.most(F.col("size")) + 1e-6)) + 1
        # of a set far from its center most that the center has is missing, as in others: the elements of its own come first
        own = ((F.col("e") + F.col("size") - F.col("c_size")) / 2).cast("int")
        halves = (F.slice("delta", F.lit(1), own), F.slice("delta", own + 1, F.col("e") - own))
        ordered = F.concat(*(F.sort_array(F.array_except(half, "common")) for half in halves), F.array_intersect("common", "delta"))
        x = x.select("c", "key", "size", "rank", "e", F.posexplode(F.slice(ordered, F.lit(1), first.cast("int"))).alias("at", "u"))
        # no more than this is shared where the element is the first that is
        held = F.struct("key", "size", "rank", "e", (F.col("e") - F.col("at")).cast("long").alias("q"))
        # the members of a change as lists, a part of them each: a change's count meets its lists, not each of its members
        lists = x.groupBy("c", "u", F.pmod(F.xxhash64("key"), F.lit(PARTS)).alias("part")).agg(F.collect_list(held).alias("held"))
        lists = self.stages.save(lists, f"lists_{r}")
        total = lists.groupBy("c", "u").agg(F.sum(F.size("held")).alias("k")).where("k > 1")
        counted = lists.select("c", "u", "part").join(total, ["c", "u"])
        return lists.join(counted, ["c", "u", "part"]).select(F.xxhash64("c", "u").alias("grp"), F.inline("held"))

    def _mixed(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """``members`` with their component, those of groups that stand in several; few: their group has few pairs across
        components for each of its members, as a small one has, or a large one with few members outside one component."""
        roots = roots.select(F.col("node").alias("key"), "root")
        here = members.drop("comp", "few").join(roots, "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
        parts = here.groupBy("grp", "comp").agg(F.count("*").alias("k"))
        n, squares = F.sum("k").cast("double"), F.sum(F.col("k").cast("double") * F.col("k"))
        mixed = parts.groupBy("grp").agg(F.count("*").alias("parts"), ((n * n - squares) / 2 <= CROWD * n).alias("few"))
        return here.join(mixed.where("parts > 1").select("grp", "few"), "grp")
