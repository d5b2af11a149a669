"""Sequence packing over histograms and bounded runs: no task ever holds a whole group.

Next-fit takes its documents in order, so a group's order is cut into runs, and what a run does to the pack that it begins
with is a small function; these are composed, and all runs are folded at once. Best-fit decreasing only needs the histogram of lengths: all packs of a pattern are filled together, and
documents find their place by their rank among documents of their length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.runtime import join_checked, materialize
from curata.sources.tables import ranged_total, running_total


def next_fit(df: DataFrame, group: str, order: str, length: str, size: int, run: int = 65_536, least_packs: int = 1) -> DataFrame:
    """``group, order, length, pack``: packs of whole sequences in order, numbered from 0 in each group.

    A pack closes when the next sequence would not fit; a longer sequence is a pack alone. With ``least_packs`` the size of
    a group's packs is its tokens divided by that, if this is less, so that there are about as many packs at least. A null
    length counts as 0, takes no room and closes no pack; a null group is a group of its own; ``order`` is an integer
    that orders a group's rows.

    The order is cut into runs of ``run`` values. For each run a task works out with what fill, and after how many packs,
    the run ends for any fill that it may begin with: this only depends on the row at which the first pack closes. These
    functions are composed run after run, in blocks, which gives every run the fill it really begins with; then all runs
    are folded at once. The packs are those of one fold over the whole group, however long the runs are.
    """
    kind, place = dict(df.dtypes)[group], dict(df.dtypes)[order]
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    rows = rows.withColumn("key", F.struct("g", F.expr(f"o div {run}").cast("long").alias("run")))
    if least_packs > 1:
        totals = rows.groupBy(F.struct("g").alias("s")).agg(F.sum("n").alias("t"))
        most = F.when(F.col("t") > 0, F.least(F.floor(F.col("t") / least_packs), F.lit(size))).otherwise(size)
        sizes = materialize(totals.select("s", most.cast("long").alias("size")), "pack-sizes")
        rows = join_checked(rows.withColumn("s", F.struct("g")), sizes, ["s"], "inner").drop("s")
    else:
        rows = rows.withColumn("size", F.lit(size).cast("long"))

    def runs(batches: Iterator[pd.DataFrame], ended) -> Iterator[pd.DataFrame]:
        """Rows of runs that ended, batch by batch; only the lengths of one run are held."""
        now, lengths = None, []
        for batch in batches:
            out = []
            for g, r, n, c in zip(batch["g"], batch["run"], batch["n"], batch["size"], strict=True):
                if now is None or r != now[1] or (g != now[0] and not (pd.isna(g) and pd.isna(now[0]))):
                    if now is not None:
                        out.append((*now, *ended(lengths, now[2])))
                    now, lengths = (g, r, c), []
                lengths.append(n)
            if out:
                yield frame(out)
        if now is not None:
            yield frame([(*now, *ended(lengths, now[2]))])

    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["g", "run", "size", *STATES])

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return runs(batches, run_function)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fill, pack = None, 0, 0
        for batch in batches:
            packs = []
            for g, r, n, c, begin, before in zip(batch["g"], batch["run"], batch["n"], batch["size"], batch["fill"], batch["pack"], strict=True):
                if now is None or r != now[1] or (g != now[0] and not (pd.isna(g) and pd.isna(now[0]))):
                    now, fill, pack = (g, r), begin, before
                if fill and fill + n > c:
                    fill, pack = 0, pack + 1
                fill += n
                packs.append(pack)
            yield pd.DataFrame({"g": batch["g"], "o": batch["o"], "n": batch["n"], "pack": packs})

    dealt = rows.select("g", "key.run", "o", "n", "size").repartition("g", "run").sortWithinPartitions("g", "run", "o")
    found = dealt.mapInPandas(functions, f"g {kind}, run long, size long, {STATE_KINDS}")
    found = materialize(found.withColumn("block", F.expr(f"run div {BLOCK_RUNS}")), "run-functions")
    starts = materialize(run_starts(found, kind), "run-starts").select(F.struct("g", "run").alias("key"), "fill", "pack")
    begun = join_checked(rows, starts, ["key"], "inner").select("g", "key.run", "o", "n", "size", "fill", "pack")
    done = begun.repartition("g", "run").sortWithinPartitions("g", "run", "o").mapInPandas(fold, f"g {kind}, o {place}, n long, pack long")
    return done.select(F.col("g").alias(group), F.col("o").alias(order), F.col("n").alias(length), "pack")


#: Runs whose functions are composed in one task; of what comes out, a row for each block, a group is folded in one task.
BLOCK_RUNS = 1024
STATES = ["needs", "packs", "fills", "first_packs", "first_fill", "total"]
STATE_KINDS = "needs array<long>, packs array<long>, fills array<long>, first_packs long, first_fill long, total long"


def run_function(lengths: list[int], size: int) -> tuple:
    """What a run does to the pack that it begins with.

    With a fill above 0 the first row whose ``need``, the run's length with it, is above the room left closes the pack: so
    many ``packs`` close in the run, and the last has such a ``fill`` at its end. If no need is, the fill only grows by
    ``total``. With an empty pack ``first_packs`` close and ``first_fill`` is there at the end.
    """
    ends = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))])
    n = len(lengths)
    known: dict[int, tuple[int, int]] = {}

    def begun_at(row: int) -> tuple[int, int]:
        """Packs that close after an empty pack is begun at ``row``, and the fill at the end."""
        path, at = [], row
        while at not in known:
            first = int(np.searchsorted(ends, ends[at], "right")) - 1  # the first row that takes room
            if first >= n:
                known[at] = (0, 0)
            elif lengths[first] > size:
                following = first + 1
            else:
                following = int(np.searchsorted(ends, ends[first] + size, "right")) - 1
            if at not in known and following >= n:
                known[at] = (0, int(ends[n] - ends[at]))
            if at in known:
                break
            path.append(at)
            at = following
        closed, fill = known[at]
        for p in reversed(path):
            closed += 1
            known[p] = (closed, fill)
        return known[row]

    needs, packs, fills = [], [], []
    for row in range(n):
        if row == 0 or lengths[row]:
            closed, fill = begun_at(row)
            needs.append(int(ends[row + 1]))
            packs.append(closed + 1)
            fills.append(fill)
            if ends[row + 1] >= size:
                break
    return (needs, packs, fills, *begun_at(0), int(ends[n]))


def after_run(state: tuple[int, int], f: tuple, size: int) -> tuple[int, int]:
    """(packs closed, fill) after a run's function."""
    closed, fill = state
    needs, packs, fills, first_packs, first_fill, total = f
    if not fill:
        return closed + first_packs, first_fill
    at = bisect_right(needs, size - fill)
    return (closed + packs[at], fills[at]) if at < len(needs) else (closed, fill + total)


def composed(f: tuple, g: tuple, size: int) -> tuple:
    """The function of a run and the next one together."""
    needs, packs, fills, first_packs, first_fill, total = f
    passed = [after_run((p, x), g, size) for p, x in zip(packs, fills, strict=True)]
    needs = list(needs)
    for need, p, x in zip(*g[:3], strict=True):
        if needs and needs[-1] >= size:
            break
        needs.append(total + need)
        passed.append((p, x))
    first = after_run((first_packs, first_fill), g, size)
    return needs, [p for p, _ in passed], [x for _, x in passed], *first, total + g[5]


def run_starts(functions: DataFrame, kind: str) -> DataFrame:
    """``g, run, fill, pack`` at the start of each run of ``functions(g, run, block, size, ...)``."""

    def in_order(frame: pd.DataFrame) -> list[tuple]:
        frame = frame.sort_values("run")
        return [(r, s, tuple(list(x) if hasattr(x, "__len__") else int(x) for x in f)) for r, s, *f in zip(frame["run"], frame["size"], *(frame[c] for c in STATES), strict=True)]

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        (_, size, f), *rest = in_order(frame)
        for _, _, g in rest:
            f = composed(f, g, size)
        return pd.DataFrame([(frame["g"].iloc[0], int(frame["block"].iloc[0]), size, *f)], columns=["g", "run", "size", *STATES])

    def states(frame: pd.DataFrame, fill: int, pack: int) -> pd.DataFrame:
        out, state = [], (pack, fill)
        for number, size, f in in_order(frame):
            out.append((frame["g"].iloc[0], number, state[1], state[0]))
            state = after_run(state, f, size)
        return pd.DataFrame(out, columns=["g", "run", "fill", "pack"])

    def from_nothing(frame: pd.DataFrame) -> pd.DataFrame:
        return states(frame, 0, 0)

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        return states(frame, int(frame["fill"].iloc[0]), int(frame["pack"].iloc[0]))

    starts = f"g {kind}, run long, fill long, pack long"
    blocks = functions.groupBy("g", "block").applyInPandas(together, f"g {kind}, run long, size long, {STATE_KINDS}")
    blocks = materialize(blocks.groupBy("g").applyInPandas(from_nothing, starts), "block-starts")
    keyed = functions.withColumn("b", F.struct("g", "block"))
    joined = join_checked(keyed, blocks.select(F.struct("g", F.col("run").alias("block")).alias("b"), "fill", "pack"), ["b"], "inner").drop("b")
    return joined.groupBy("g", "block").applyInPandas(within, starts)


def best_fit_patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ``(((length, times), ...), packs)`` of best-fit decreasing: longest first, each into the open pack with the
    least room that is enough, else into a new pack; longer documents are a pack each.

    A pack that has just taken a length has the least room for the next of that length, so it takes as many as fit before
    another pack is opened: packs of one room fill alike, and a length changes whole patterns but for one rest.
    """
    room: dict[int, list[tuple[tuple, int]]] = {}
    spaces: list[int] = []
    full = []

    def put(space: int, pattern: tuple, packs: int) -> None:
        if packs and space <= 0:
            full.append((pattern, packs))
        elif packs:
            if space not in room:
                room[space] = []
                insort(spaces, space)
            room[space].append((pattern, packs))

    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            at = bisect_left(spaces, n)
            if at == len(spaces):
                space, pattern, packs = max(size, n), (), left  # as many new packs as could be wanted
            else:
                space = spaces[at]
                pattern, packs = room[space].pop()
                if not room[space]:
                    del room[space], spaces[at]
            each = space // n
            whole = min(packs, left // each)
            rest = min(left - whole * each, each - 1) if packs > whole else 0
            put(space - each * n, (*pattern, (n, each)), whole)
            put(space - rest * n, (*pattern, (n, rest)), int(rest > 0))
            if pattern:
                put(space, pattern, packs - whole - (rest > 0))
            left -= whole * each + rest
    return full + [(p, k) for s in spaces for p, k in room[s]]


def slots_of(patterns: list) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``length, first rank, documents, times in a pack, first pack, offset`` of each run of equal places."""
    taken: dict[int, int] = {}
    first_pack = 0
    for pattern, packs in patterns:
        offset = 0
        for n, times in pattern:
            yield n, taken.get(n, 0), times * packs, times, first_pack, offset
            taken[n] = taken.get(n, 0) + times * packs
            offset += n * times
        first_pack += packs


def ranked(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """``df`` with ``rank`` from 0 within ``group`` along an integer ``order``, counted in buckets of the order."""
    return running_total(df.withColumn("one", F.lit(1)), order, "one", group=group).withColumnRenamed("begin", "rank").drop("one")


def in_order_of_first(packed: DataFrame, group: str, order: str, full: int | None = None, length: str = "") -> DataFrame:
    """Packs numbered anew, from 0 in each group, by the least ``order`` of their documents; with ``full`` only packs that
    have so many tokens are kept. A pack is one row when it is numbered, however many groups or packs there are."""
    sums = [F.sum(length).alias("tokens")] if full else []
    firsts = packed.groupBy(group, "pack").agg(F.min(order).alias("least"), *sums)
    firsts = ranked(firsts.where(F.col("tokens") == full) if full else firsts, [group], "least")
    key = F.struct(group, "pack")
    placed = materialize(firsts.select(key.alias("p"), F.col("rank").alias("number")), "pack-order")
    return packed.withColumn("p", key).join(placed, "p").withColumn("pack", F.col("number")).drop("p", "number")


def best_fit(df: DataFrame, group: str, order: str, length: str, size: int, over_long: str = "alone") -> DataFrame:
    """``group, order, length, pack, offset`` of best-fit decreasing within each group; packs are numbered from 0.

    Of equal lengths the lesser ``order`` comes first. A document longer than ``size`` is a pack of its own, or with
    ``over_long="raise"`` an error. Only a group's
    histogram of lengths is in one task, and of it the driver sees nothing; null lengths count as 0 and take no room.
    """
    rows = df.select(group, order, F.coalesce(length, F.lit(0)).cast("long").alias(length))
    if over_long == "raise" and (found := rows.where(F.col(length) > size).first()):
        raise ValueError(f"document {found[order]} has {found[length]} tokens, a pack {size}")
    counts = rows.groupBy(group, length).agg(F.count("*").alias("documents_of_length"))
    kind = dict(rows.dtypes)[group]
    places = f"{group} {kind}, {length} long, first long, docs long, times long, first_pack long, offset long"

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        histogram = {int(n): int(k) for n, k in zip(frame[length], frame["documents_of_length"], strict=True)}
        empty = histogram.pop(0, 0)
        found = list(slots_of(best_fit_patterns(histogram, size)))
        found += [(0, 0, empty, empty, 0, 0)] if empty else []
        out = pd.DataFrame(found, columns=[length, "first", "docs", "times", "first_pack", "offset"])
        out.insert(0, group, frame[group].iloc[0])
        return out

    slots = materialize(counts.groupBy(group).applyInPandas(pack, places), "pack-slots")
    held = slots.groupBy(F.struct(group, length).alias("curata_key")).agg(F.collect_list(F.struct("first", "docs", "times", "first_pack", "offset")).alias("slots"))  # a few for a length
    mine = F.get(F.filter("slots", lambda s: (F.col("rank") >= s["first"]) & (F.col("rank") < s["first"] + s["docs"])), F.lit(0))
    out = ranked(rows, [group, length], order).withColumn("curata_key", F.struct(group, length))  # joins null with null
    out = out.join(held.hint("merge"), "curata_key").withColumn("s", mine)
    nth = F.col("rank") - F.col("s.first")
    return out.select(
        group, order, length, (F.col("s.first_pack") + F.floor(nth / F.col("s.times"))).alias("pack"), (F.col("s.offset") + F.col(length) * (nth % F.col("s.times"))).alias("offset")
    )


def select_packs(packs: DataFrame, uid: str, tokens: str, count: int, target: int, tolerance: int, priority: Column) -> DataFrame:
    """``count`` packs by priority, then single swaps with packs that were left out until the tokens are near ``target``.

    Every swap is the best one, and they end when the tokens are within the tolerance or no swap brings them nearer; of a
    size the last chosen goes and the first left out comes. Swaps are found over the histograms of sizes, which have a row
    for each size of a pack at most; as long as the largest swap is the best, it is made as often at once as it stays so.
    They are applied by rank within the swapped sizes. The first ``count`` are told by their place in the order of
    priority, which is counted by ranges.
    """
    every = materialize(packs.select(uid, F.col(tokens).alias("t"), priority.alias("p")), "pack-priorities")
    place = ranged_total(every, ["p", uid], F.lit(1), "place")
    marked = materialize(place.withColumn("in", F.col("place") < count).drop("place"), "marked-packs")
    out_of, into = {}, {}
    for r in marked.groupBy("t", "in").agg(F.count("*").alias("n")).collect():  # at most a row for each size and side
        (out_of if r["in"] else into)[r.t] = r.n
    total = sum(t * n for t, n in out_of.items())
    sizes = sorted(into)
    went: dict[int, int] = {}
    came: dict[int, int] = {}
    while abs(total - target) > tolerance and sizes and out_of:
        best = None
        for a in sorted(out_of):
            at = bisect_left(sizes, target - total + a)
            for b in sizes[max(0, at - 1) : at + 1]:
                best = min(best or (abs(total - target), a, b), (abs(total - a + b - target), a, b))
        if best[0] >= abs(total - target):
            break
        _, a, b = best
        times, missing = 1, target - total
        if (a, b) in ((min(out_of), sizes[-1]), (max(out_of), sizes[0])) and abs(b - a) <= abs(missing):  # the largest step
            times = min(out_of[a], into[b], missing // (b - a))
        total += times * (b - a)
        went[a], came[b] = went.get(a, 0) + times, came.get(b, 0) + times
        out_of[a] -= times
        into[b] -= times
        if not out_of[a]:
            del out_of[a]
        if not into[b]:
            del into[b]
            sizes.remove(b)
    swapped = sorted({*went, *came})
    if not swapped:
        return marked.where(F.col("in")).select(uid, F.col("t").alias(tokens))
    amount = lambda d: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (d or {-1: 0}).items() for x in kv]), F.col("t")), F.lit(0))
    near = marked.where(F.col("t").isin(swapped))
    most = max([*went.values(), *came.values()])
    tail = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("p"), F.desc(uid)))
    head = F.row_number().over(Window.partitionBy("t").orderBy("p", uid))
    gone = near.where(F.col("in")).withColumn("r", tail).where(F.col("r") <= most).where(F.col("r") <= amount(went))
    come = near.where(~F.col("in")).withColumn("r", head).where(F.col("r") <= most).where(F.col("r") <= amount(came))
    kept = marked.where(F.col("in")).join(gone.select(uid), uid, "left_anti")
    return kept.select(uid, "t").unionByName(come.select(uid, "t")).withColumnRenamed("t", tokens)
