"""The registered queries of the engine's own operators, and the SQL that each must agree with.

Driver tables hold no boards, so draughts queries run over the synthetic self-play view of all of `lineitem`, and chess queries
over positions derived from all of `orders`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyworks import synthetic
from plyworks.functions import chess, evaluation
from plyworks.functions import lines as L
from plyworks.oracles import SQL
from plyworks.operators import inventory, networks, training
from plyworks.operators import samples as S
from plyworks.operators.parse import parse
from plyworks.variants import get

H = 8
FILIPINO = get("filipino")
LABELS = S.Labels()

# Chess positions by rule: kings and rooks of every file, pawns, and a side to move, from an order's numbers.
PLACEMENTS = (
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR",
    "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R",
    "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8",
    "r4rk1/1pp1qppp/p1np1n2/2b1p1B1/2B1P1b1/P1NP1N2/1PP1QPPP/R4RK1",
    "rk2r3/pppppppp/8/8/8/8/PPPPPPPP/RK2R3",
    "4k3/8/8/3pP3/8/8/8/4K2R",
    "b3k2b/1p4p1/8/8/8/8/1P4P1/B3K2B",
    "8/8/8/8/8/8/8/K6k",
    "rnbqkbnr/pppppppp/9/8/8/8/PPPPPPPP/RNBQKBNR",
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPP/RNBQKBNR",
    "rnbq1bnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR",
)
CASTLING, PASSANT = ("-", "KQkq", "Kq", "Aa", "Ee", "x"), ("-", "d6", "e3", "i9")


def _parsed(spark: SparkSession, sf_dir: str, name: str = "filipino") -> DataFrame:
    """The view's lines as a variant's, with the hash of the qualifier <variant>/w<file>.txt."""
    v = get(name)
    lines = synthetic.selfplay(spark, sf_dir)
    hashes = F.create_map(*(x for i in range(4) for x in (F.lit(i), F.lit(L.fnv1a_of(f"{v.name}/w{i}.txt:".encode())))))
    return parse(lines.withColumn("qual_hash", F.element_at(hashes, F.col("file_idx").cast("int")).cast("bigint")), v)


def _samples(spark: SparkSession, sf_dir: str, name: str = "filipino") -> DataFrame:
    return S.samples(_parsed(spark, sf_dir, name), get(name), LABELS)


def _chess_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, fen, line) of every order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    i, c = F.col("id"), F.col("c")
    fen = F.concat_ws(" ", pick(PLACEMENTS, i), F.when(c % 2 == 0, "w").otherwise("b"), pick(CASTLING, i + c), pick(PASSANT, c), (i % 100).cast("string"), (c % 50 + 1).cast("string"))
    rest = F.concat_ws(" ", pick(("1-0", "0-1", "1/2-1/2", "*"), i + c * 3), (i % 300).cast("string"), F.when(i % 3 == 0, (c % 900 - 450).cast("string")))
    return o.select("id", fen.alias("fen"), F.concat_ws(" ", fen, rest).alias("line"))


def test_network(name: str = "filipino", h: int = H) -> networks.Network:
    """Weights by arithmetic, which SQL can repeat: hundredths from -0.30 to 0.30."""
    v = get(name)
    f, j, b = np.arange(v.n_features)[:, None], np.arange(h)[None, :], np.arange(v.buckets)[:, None]
    w1 = ((f * 31 + j * 17) % 61 - 30) / 100
    w2 = ((b * 13 + j * 29) % 101 - 50) / 100
    return networks.Network(v, w1, (np.arange(h) * 7 % 11 - 3) / 20, w2, 0.25 if v.chess else 0.0)


# --- Draughts lines -----------------------------------------------------------------------------------------------------------


def tokenize(spark, sf_dir):
    p = L.fields(F.col("line"), 5)
    return synthetic.selfplay(spark, sf_dir).select("ord", F.size(p).cast("bigint").alias("n_tokens"), F.array_join(p, "|").alias("tokens"))


def parsed_lines(spark, sf_dir):
    return _parsed(spark, sf_dir).where("accepted").select("ord", "gid", "outcome", "eval", "key", F.col("tb_skip").cast("int").alias("tb_skip"))


def accept_split(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy("file_idx").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("malformed"))


def tbskip(spark, sf_dir, name):
    return _parsed(spark, sf_dir, name).groupBy("file_idx").agg(F.count_if("tb_skip").alias("tbskip"))


def counts(spark, sf_dir):
    board = F.get(L.fields(F.col("line"), 5), F.lit(0))
    n = L.counts(board)
    return synthetic.selfplay(spark, sf_dir).select("ord", *(n[g].cast("bigint").alias(name) for g, name in zip("XOKQ", ("x_men", "o_men", "x_kings", "o_kings"))))


def inv_per_file(spark, sf_dir):
    return inventory.per_file(_parsed(spark, sf_dir))


def inv_total(spark, sf_dir):
    return inventory.total(_parsed(spark, sf_dir)).withColumn("dedup", F.round("dedup", 9))


def inv_games(spark, sf_dir):
    return inventory.games_by_file(_parsed(spark, sf_dir))


def inv_unique(spark, sf_dir):
    return inventory.unique_by_file(_parsed(spark, sf_dir))


def rollup_total(spark, sf_dir):
    rows = None
    for name in ("filipino", "english", "russian"):
        one = inventory.total(_parsed(spark, sf_dir, name)).drop("dedup")
        rows = one if rows is None else rows.unionByName(one)
    packed = rows.limit(1).select("files", F.lit(None).cast("bigint").alias("games"), "lines", "unique", F.lit(None).cast("bigint").alias("malformed"), "tbskip", F.lit(0).cast("bigint").alias("nogameid"))
    out = inventory.rollup_total(rows.unionByName(packed))
    return out.select(*(F.col(c).cast("bigint").alias(c) for c in out.columns))


def features(spark, sf_dir, name):
    found = S.inputs(_parsed(spark, sf_dir, name).where("accepted").select("key").distinct(), get(name))
    return found.select("key", F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("features"), F.col("anchor").cast("bigint").alias("anchor"), F.col("bucket").cast("bigint").alias("bucket"))


def mirror_features(spark, sf_dir):
    found = S.inputs(_parsed(spark, sf_dir).where("accepted").select("key").distinct(), FILIPINO)
    turned = L.mirrored(F.col("features"), FILIPINO)
    return found.select("key", L.mirror_board(F.col("key")).alias("mirror_board"), F.array_join(F.transform(F.sort_array(turned), lambda x: x.cast("string")), ",").alias("mirrored"))


def padded_features(spark, sf_dir):
    found = _samples(spark, sf_dir)
    return found.select("first_ord", F.array_join(F.transform(L.padded(F.col("features"), 32, 128), lambda x: x.cast("string")), ",").alias("padded"))


def bucket_hist(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy(F.col("bucket").cast("bigint").alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("bigint")).alias("anchor_sum"))


def dedup_first_seen(spark, sf_dir):
    return S.deduplicate(_parsed(spark, sf_dir), FILIPINO).select("key", "first_ord", "n", "n_eval")


def avg_outcome(spark, sf_dir):
    return S.deduplicate(_parsed(spark, sf_dir), FILIPINO).select("key", F.round("outcome", 9).alias("outcome"), F.round("eval", 9).alias("eval"))


def eval_blend(spark, sf_dir):
    return _samples(spark, sf_dir).select("first_ord", F.round("y", 9).alias("y"), "n", "n_eval")


def fnv_group_hash(spark, sf_dir):
    return S.deduplicate(_parsed(spark, sf_dir), FILIPINO).select("first_ord", "hash")


def holdout_split(spark, sf_dir):
    return _samples(spark, sf_dir).select("first_ord", F.col("is_valid").cast("int").alias("is_valid"))


def loader_stats(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    out = S.stats(parsed, FILIPINO, LABELS)
    return out.select(*(F.col(c).cast("bigint").alias(c) for c in out.columns))


def max_lines(spark, sf_dir):
    return S.first_lines(_parsed(spark, sf_dir), 1000).select("ord", F.col("tb_skip").cast("int").alias("tb_skip"))


def csr_offsets(spark, sf_dir):
    return S.with_offsets(_samples(spark, sf_dir)).select("first_ord", "off", "end")


def train_order(spark, sf_dir):
    found = training.ranks(_samples(spark, sf_dir).where("not is_valid").select("first_ord"), "first_ord")
    return found.select("first_ord", F.col("rank").cast("bigint").alias("rank"))


# --- Networks -----------------------------------------------------------------------------------------------------------------


def anchor_mse(spark, sf_dir):
    return networks.anchor_mse(_samples(spark, sf_dir), LABELS.k(FILIPINO)).select(F.round("mse", 9).alias("mse"))


def forward_float(spark, sf_dir):
    return networks.with_output(_samples(spark, sf_dir), test_network()).select("first_ord", F.round("net", 6).alias("net"))


def score16(spark, sf_dir):
    return networks.with_score(_samples(spark, sf_dir), networks.quantize(test_network())).select("first_ord", "score")


def score16_narrow(spark, sf_dir):
    return networks.with_score(_samples(spark, sf_dir), networks.quantize(test_network()), narrow=True).select("first_ord", "score")


def float_mse(spark, sf_dir):
    return networks.mse(_samples(spark, sf_dir), test_network(), LABELS.k(FILIPINO)).select(F.round("mse", 7).alias("mse"))


def quant_mse(spark, sf_dir):
    return networks.mse(_samples(spark, sf_dir), networks.quantize(test_network()), LABELS.k(FILIPINO)).select(F.round("mse", 7).alias("mse"))


def acc_bound(spark, sf_dir):
    return networks.acc_bound(_samples(spark, sf_dir), networks.quantize(test_network()))


def quantize(spark, sf_dir):
    """W1 of the arithmetic network as the quantizer has it; a row for each weight of a model."""
    small = networks.quantize(test_network())
    return spark.createDataFrame([(f, j, int(x)) for f, row in enumerate(small.w1) for j, x in enumerate(row)], "f bigint, j bigint, w1 bigint")


def grad_step(spark, sf_dir):
    """The gradient of one full batch with respect to W2, summed over chunks."""
    net, rows = test_network(), _samples(spark, sf_dir).where("not is_valid")
    ranked = training.ranks(rows.select("first_ord", "features", "bucket", "anchor", "y"), "first_ord")
    n = ranked.count()
    batch = ranked.withColumnRenamed("rank", "pos").withColumn("chunk", F.floor(((F.col("pos") + 1) * training.CHUNKS - 1) / n).cast("int"))
    _, grads = training.reduced(training.partial_gradients(batch, net, LABELS.k(FILIPINO)), net)
    found = [(b, j, float(grads[2][b, j])) for b in range(net.buckets) for j in range(net.h)]
    return spark.createDataFrame(found, "bucket bigint, j bigint, dw2 double").withColumn("dw2", F.round("dw2", 6))


def lr_schedule(spark, sf_dir):
    o = training.MINIBATCH
    rows = [(e, training.learning_rate(o, e)) for e in range(1, o.epochs + 1)]
    return spark.createDataFrame(rows, "epoch bigint, lr double").withColumn("lr", F.round("lr", 12))


# --- Chess --------------------------------------------------------------------------------------------------------------------


def _positions(spark, sf_dir):
    return chess.with_position(_chess_lines(spark, sf_dir), "fen")


def fen_placement(spark, sf_dir):
    return _positions(spark, sf_dir).where("position is not null").select("id", F.col("position.squares").alias("squares"), chess.piece_count(F.col("position.squares")).cast("bigint").alias("pieces"))


def fen_round_trip(spark, sf_dir):
    found = _positions(spark, sf_dir).where("position is not null")
    return found.select("id", chess.to_fen(F.col("position")).alias("fen"), chess.key(F.col("position")).alias("key"))


def chess_features(spark, sf_dir):
    found = _positions(spark, sf_dir).where("position is not null")
    got = chess.features(F.col("position.squares"), F.col("position.stm"))
    return found.select("id", F.array_join(F.transform(got, lambda x: x.cast("string")), ",").alias("features"))


def chess_flip(spark, sf_dir):
    lines = _chess_lines(spark, sf_dir).select(F.lit(0).alias("file_idx"), F.col("id").alias("ord"), "line")
    return parse(lines, get("chess")).where("accepted").select("ord", "gid", "outcome", "eval")


def chess_eval(spark, sf_dir):
    found = _positions(spark, sf_dir).where("position is not null")
    return found.select("id", evaluation.anchor_cp(evaluation.eval_classical(F.col("position.squares"), F.col("position.stm"))).cast("bigint").alias("anchor"))


def score_cp(spark, sf_dir):
    found = _positions(spark, sf_dir).where("position is not null")
    rows = found.select("id", chess.features(F.col("position.squares"), F.col("position.stm")).alias("features"), F.lit(0).alias("bucket"))
    return networks.with_score(rows, networks.quantize(test_network("chess"))).select("id", "score")


def _named(f, *args, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir, *args)

    query.__name__ = name
    return query


EIGHT = ("filipino", "brazilian", "english", "russian", "turkish")
_PLAIN = (
    tokenize, parsed_lines, accept_split, counts, inv_per_file, inv_total, inv_games, inv_unique, rollup_total, mirror_features, padded_features, bucket_hist, dedup_first_seen,
    avg_outcome, eval_blend, fnv_group_hash, holdout_split, loader_stats, max_lines, csr_offsets, train_order, anchor_mse, forward_float, score16, score16_narrow, float_mse,
    quant_mse, acc_bound, quantize, grad_step, lr_schedule, fen_placement, fen_round_trip, chess_features, chess_flip, chess_eval, score_cp,
)


def queries():
    found = {f.__name__: f for f in _PLAIN}
    found |= {f"tbskip_{n}": _named(tbskip, n, name=f"tbskip_{n}") for n in EIGHT}
    return found | {f"features_{n}": _named(features, n, name=f"features_{n}") for n in EIGHT}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
