"""Mixing sources to target weights: a min-cost flow decides how many words of each kind of document go to which source.

Documents are aggregated by membership pattern, the sorted set of the sources they belong to. Word capacity flows from patterns
to the sources' quotas; a pattern's first pass costs nothing and each repetition more than the one before. A pattern's
documents are put in a seeded order and its flow is laid along their repeated passes, so each source takes an interval of the
passes, and where an interval ends is a threshold on the documents' seeded hash. Thresholds are found digit by digit with
grouped sums, so no source's documents ever meet in one task; a few documents that fit then close what gap is left.

Results for odd input: a null text has size 0; a null source is a source of its own and comes last; rows of one id are taken
alike; sources without words have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plyworks.llm.common import OWN, materialize, n_words_of, text_of

WEIGHTS, PASSES, SEED = (5, 2, 1), 3, 20261
#: Costs of the passes are convex: with another pass, a later repetition never replaces an earlier one.
COSTS = (0, 1, 3)
#: Patterns are the only thing that reaches the driver, and are what its memory must hold. More of them are an error, not a cut.
MAX_PATTERNS = 1_000_000
#: Rows of the plan that are broadcast; a larger plan is joined by shuffles.
BROADCAST_ROWS = 50_000
HASH_BITS, DIGIT = 60, 12
#: Rounds in which each pattern may take one more document that fits its gap.
FILLS = 4


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> dict[str | None, Fraction]:
    """Each source's share of all words by weight, at most `passes` times its own; what is above is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, Fraction] = {}
    left, free = Fraction(sum(sizes.values())), list(order)
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] > total * passes * sizes[s]]
        for s in full or free:
            out[s] = Fraction(passes * sizes[s]) if full else left * weight[s] / total
        if not full:
            break
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def route(patterns: list[tuple[tuple[str | None, ...], int]], quotas: dict[str | None, int], costs: tuple[int, ...] = COSTS) -> dict[tuple[int, str | None], int]:
    """The words that pattern i gives to source s, of least total repetition cost: successive shortest paths."""
    sources = {s: k for k, s in enumerate(quotas)}
    n, first = 2 + len(patterns) + len(sources), 2 + len(patterns)
    heads: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((capacity, 0))
        cost.extend((price, -price))
        return len(to) - 2

    given = {}
    for i, (members, words) in enumerate(patterns):
        for price in costs:
            arc(0, 2 + i, words, price)
        for s in dict.fromkeys(members):
            if s in quotas:
                given[i, s] = arc(2 + i, first + sources[s], words * len(costs), 0)
    for s, k in sources.items():
        arc(first + k, 1, quotas[s], 0)
    while True:
        far, via, queue, queued = [None] * n, [-1] * n, deque([0]), [False] * n
        far[0] = 0
        while queue:
            a = queue.popleft()
            queued[a] = False
            for e in heads[a]:
                if room[e] > 0 and (far[to[e]] is None or far[a] + cost[e] < far[to[e]]):
                    far[to[e]], via[to[e]] = far[a] + cost[e], e
                    if not queued[to[e]]:
                        queue.append(to[e])
                        queued[to[e]] = True
        if far[1] is None:
            break
        path, b = [], 1
        while b:
            path.append(via[b])
            b = to[via[b] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return {key: room[e + 1] for key, e in given.items() if room[e + 1]}


def routed(patterns: list[tuple[tuple[str | None, ...], int]], quotas: dict[str | None, int], costs: tuple[int, ...] = COSTS) -> dict[tuple[int, str | None], int]:
    """route(), with the network of each set of sources that patterns tie together by itself. A source that shares no pattern takes what its own has, pass by pass."""
    root = {s: s for s in quotas}

    def of(s):
        while root[s] != s:
            root[s] = s = root[root[s]]
        return s

    for members, _ in patterns:
        for s in members[1:]:
            root[of(s)] = of(members[0])
    nets: dict[str | None, list[int]] = {}
    for i, (members, _) in enumerate(patterns):
        if members:
            nets.setdefault(of(members[0]), []).append(i)
    out = {}
    for some in nets.values():
        if len(some) == 1 and len(patterns[some[0]][0]) == 1:
            (s,), words = patterns[some[0]]
            if amount := min(quotas[s], words * len(costs)):
                out[some[0], s] = amount
            continue
        own = dict.fromkeys(s for i in some for s in patterns[i][0])
        for (i, s), amount in route([patterns[i] for i in some], {s: quotas[s] for s in own}, costs).items():
            out[some[i], s] = amount
    return out


def sized(docs: DataFrame, sources: Column, text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(doc_id, pattern, size, hash): what the mix needs of each row, written once."""
    pattern = F.array_sort(F.array_distinct(sources))
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 64 - HASH_BITS)
    return materialize(docs.select(F.col(doc_id).alias("doc_id"), pattern.alias("pattern"), n_words_of(text_of(text)).alias("size"), hashed.alias("hash")), "mix-sizes")


class Plan:
    """What the driver knows: targets, and for each pattern and source where its interval of the passes ends."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        found = rows.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
        if len(found) > MAX_PATTERNS:
            raise ValueError(f"over {MAX_PATTERNS} membership patterns")
        key = lambda r: [(s is None, s or "") for s in r["pattern"]]
        self.patterns = [(tuple(r["pattern"]), r["words"]) for r in sorted(found, key=key)]
        self.sizes: dict[str | None, int] = {}
        for members, words in self.patterns:
            for s in members:
                self.sizes[s] = self.sizes.get(s, 0) + words
        self.targets = targets(self.sizes)
        self.flow = routed(self.patterns, {s: round(t) for s, t in self.targets.items()})
        #: pattern number, source, whole passes, words of the last pass; in the order of the intervals.
        self.cuts: list[dict] = []
        for i, (members, words) in enumerate(self.patterns):
            end = 0
            for s in members:
                if amount := self.flow.get((i, s)):
                    end += amount
                    self.cuts.append({"p": i, "source": s, "passes": end // words, "gap": end % words, "last": False})
            if end:
                self.cuts[-1]["last"] = True
        self._thresholds(rows)

    def table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def bounded(self, rows: list[tuple], schema: str) -> DataFrame:
        """table(), to be broadcast up to a number of rows."""
        out = self.table(rows, schema)
        return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out

    def _thresholds(self, rows: DataFrame) -> None:
        for c in self.cuts:
            c |= {"prefix": 0, "threshold": 0}
        open_cuts = [k for k, c in enumerate(self.cuts) if c["gap"]]
        for level in range(1, HASH_BITS // DIGIT + 1):
            if not open_cuts:
                break
            left = HASH_BITS - level * DIGIT
            now = self.bounded([(k, list(self.patterns[self.cuts[k]["p"]][0]), self.cuts[k]["prefix"], self.cuts[k]["gap"]) for k in open_cuts], "k int, pattern array<string>, prefix bigint, gap bigint")
            digit = F.shiftright(F.col("hash"), left)
            inside = rows.join(now, rows["pattern"].eqNullSafe(now["pattern"]) & (F.shiftright(digit, DIGIT) == F.col("prefix")))
            cells = inside.groupBy("k", "gap", digit.alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
            upto = F.sum("words").over(Window.partitionBy("k").orderBy("cell"))
            edge = cells.withColumn("upto", upto).where("upto > gap").groupBy("k").agg(F.min(F.struct("cell", "upto", "words", "rows")).alias("edge"))
            found = {r["k"]: r["edge"] for r in edge.collect()}
            for k in open_cuts:
                c, e = self.cuts[k], found[k]
                c["gap"] -= e["upto"] - e["words"]
                c["prefix"], c["threshold"] = e["cell"], e["cell"] << left
            open_cuts = [k for k in open_cuts if self.cuts[k]["gap"] and found[k]["rows"] > 1]
        self._fill(rows)

    def _fill(self, rows: DataFrame) -> None:
        """One document at a time that fits the gap behind a pattern's last interval, the largest first; in the end the least that is too large, if that comes nearer."""
        self.extra: dict[int, list[int]] = {}
        for last in [False] * FILLS + [True]:
            now = [(k, list(self.patterns[c["p"]][0]), c["threshold"], c["gap"], self.extra.get(k, [])) for k, c in enumerate(self.cuts) if c["last"] and c["gap"] > 0]
            if not now:
                break
            cuts = self.bounded(now, "k int, pattern array<string>, threshold bigint, gap bigint, extra array<bigint>")
            left = rows.join(cuts, rows["pattern"].eqNullSafe(cuts["pattern"])).where("hash >= threshold and size > 0 and not array_contains(extra, hash)")
            one = F.struct("size", "hash")
            best = F.min(F.when(F.col("size").between(F.col("gap") + 1, 2 * F.col("gap") - 1), one)) if last else F.max(F.when(F.col("size") <= F.col("gap"), one))
            for r in left.groupBy("k").agg(best.alias("best")).where("best is not null").collect():
                self.cuts[r["k"]]["gap"] -= r["best"]["size"]
                self.extra.setdefault(r["k"], []).append(r["best"]["hash"])

    def copies(self, rows: DataFrame) -> DataFrame:
        """rows with OWN + source and OWN + copies, a row for each source that takes the document."""
        before: dict[int, tuple[int, int]] = {}
        out = []
        for k, c in enumerate(self.cuts):
            passes, threshold = before.get(c["p"], (0, 0))
            out.append((list(self.patterns[c["p"]][0]), c["source"], c["passes"], c["threshold"], passes, threshold, self.extra.get(k, [])))
            before[c["p"]] = (c["passes"], c["threshold"])
        cuts = self.bounded(out, f"{OWN}pattern array<string>, {OWN}source string, {OWN}passes bigint, {OWN}threshold bigint, {OWN}passes0 bigint, {OWN}threshold0 bigint, {OWN}extra array<bigint>")
        c = lambda x: F.col(OWN + x)
        upto = lambda n: c("passes" + n) + (F.col("hash") < c("threshold" + n)).cast("long")
        extra = F.array_contains(c("extra"), F.col("hash")).cast("long")
        joined = rows.join(cuts, rows["pattern"].eqNullSafe(c("pattern")), "left")
        return joined.withColumn(OWN + "copies", F.coalesce(upto("") - upto("0") + extra, F.lit(0))).drop(*(OWN + x for x in ("pattern", "passes", "threshold", "passes0", "threshold0", "extra")))


def mix(docs: DataFrame, sources: Column, text: str = "text", doc_id: str = "doc_id") -> tuple[Plan, DataFrame]:
    """The plan, and (doc_id, pattern, size, hash, OWN + source, OWN + copies)."""
    rows = sized(docs, sources, text, doc_id)
    plan = Plan(rows)
    return plan, plan.copies(rows)


def mixed(docs: DataFrame, sources: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents of the mix with the caller's columns, each as often as it is taken. Thresholds are looked up row by row: no text is shuffled."""
    rows = sized(docs, sources, text, doc_id)
    plan = Plan(rows)
    columns = [F.col(c).alias(f"{OWN}{i}") for i, c in enumerate(docs.columns)]
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(doc_id)), 64 - HASH_BITS)
    taken = plan.copies(docs.select(*columns, F.array_sort(F.array_distinct(sources)).alias("pattern"), hashed.alias("hash")))
    taken = taken.where(F.col(OWN + "copies") > 0).withColumn(OWN + "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(OWN + "copies"))))
    return taken.select(*(F.col(f"{OWN}{i}").alias(c) for i, c in enumerate(docs.columns)))
