"""The training command: load or pack a corpus, train, quantize, score and write networks.

Exit codes: 0 done, 2 usage, 4 an accumulator of a draughts network leaves 16 bits.
"""

from __future__ import annotations

import argparse
import dataclasses
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyworks.functions import evaluation
from plyworks.functions import lines as L
from plyworks.operators import networks, training
from plyworks.operators import samples as S
from plyworks.operators.parse import parse
from plyworks.sources import discovery, packed, text, weights
from plyworks.variants import VARIANTS, Variant, get

OK, USAGE, OVERFLOW = 0, 2, 4
log = logging.getLogger("plyworks.train")


@dataclasses.dataclass
class Corpus:
    samples: DataFrame
    stats: dict
    k: float


def load_text(spark: SparkSession, globs, v: Variant, how: S.Labels, group_key: str = "rel", tables: evaluation.Weights | None = None) -> Corpus:
    """Samples of text files; the parsed positions are kept, as statistics and training read them again."""
    files = discovery.expand(spark, globs)
    parsed = parse(text.without_long(text.read_lines(spark, files, v, group_key)), v)
    found = S.samples(parsed, v, how, tables).persist()
    stats = S.stats(parsed, v, how).first().asDict()
    if not stats["train"]:
        raise ValueError(f"no training samples; check the variant ({v.name})")
    return Corpus(found, stats, how.k(v))


def load_packed(spark: SparkSession, path: str, v: Variant, k: float | None = None) -> Corpus:
    """Samples of a packed corpus; its own K unless another is asked for."""
    info = packed.read_header(path)
    stats = {n: getattr(info, n) for n in ("lines", "unique", "train", "valid", "tbskip", "evalpos")}
    found = packed.read(spark, path, v)
    if not info.train:
        raise ValueError(f"{path} has no training samples")
    return Corpus(found, stats, packed.stored_k(info) if k is None else k)


def probe(spark: SparkSession, lines: DataFrame, net: networks.Network, tables: evaluation.Weights | None = None, narrow: bool = False) -> DataFrame:
    """(ord, board, score) of lines that start with a board, or with a FEN for chess; malformed lines have no score."""
    v = net.variant
    if v.chess:
        from plyworks.functions import chess

        df = chess.with_position(lines, "line").withColumn("key", chess.key(F.col("position")))
    else:
        df = lines.withColumn("key", L.pack_key(F.get(L.fields(F.col("line"), 1), F.lit(0))))
        df = df.withColumn("key", F.when(F.length("key") == v.cells, F.col("key")))
    found = S.inputs(df.where("key is not null").select("ord", F.col("line").alias("board"), "key"), v, tables)
    return networks.with_score(found.select("ord", "board", "features", "bucket"), net, narrow=narrow).select("ord", "board", "score")


def ship(rows: DataFrame, net: networks.Network, k: float) -> tuple[networks.Network, dict]:
    """The quantized network with its error and bounds; `fits` tells whether a 16-bit accumulator can hold them."""
    small = networks.quantize(net) if not net.quantized else net
    bound = networks.acc_bound(rows, small).first()
    fits = small.variant.chess or (-32768 <= bound["lo"] and bound["hi"] <= 32767)
    return small, {"mse": networks.mse(rows, small, k).first()["mse"], "lo": bound["lo"], "hi": bound["hi"], "fits": fits}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("trainer")
    p.add_argument("--variant", default="")
    p.add_argument("--list-variants", action="store_true")
    for name in ("data", "root", "probe"):
        p.add_argument(f"--{name}", action="append", default=[])
    for name in ("corpus", "out-corpus", "out", "outh", "out-netbin", "log", "load", "tables", "probe-file", "convert"):
        p.add_argument(f"--{name}", default="")
    for name in ("pack", "eval-only", "probe-int16"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--group-key", choices=discovery.GROUP_KEYS, default="rel")
    p.add_argument("--algo", choices=("minibatch", "online"), default="minibatch")
    p.add_argument("--opt", choices=("adam", "adagrad"))
    p.add_argument("--lr-schedule", choices=("cosine", "const"))
    for name, kind in (("h", int), ("buckets", int), ("epochs", int), ("batch", int), ("warmup-epochs", int), ("lr", float), ("k", float)):
        p.add_argument(f"--{name}", type=kind)
    p.add_argument("--lambda", dest="lam", type=float, default=0.5)
    p.add_argument("--holdout", type=int, default=20)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--max-lines", type=int, default=0)
    return p


def list_variants() -> str:
    return "\n".join(f"{v.name:<14} features {v.n_features:>3}  buckets {v.buckets}  skip: {v.skip_doc}" for v in VARIANTS.values())


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    v = get(a.variant)
    if a.data and a.corpus:
        raise ValueError("--corpus and --data exclude each other")
    if a.algo == "online" and v.chess:
        raise ValueError("the chess kernel has no online trainer")
    if a.buckets and a.buckets not in (1, v.buckets):
        raise ValueError(f"{v.name} has 1 or {v.buckets} buckets")
    tables = evaluation.Weights.load(a.tables) if a.tables else None
    if a.load and (a.probe or a.probe_file or a.convert):
        net = weights.read(a.load, v)
        if a.convert:
            with open(a.convert, "w") as f:
                f.write(weights.header(net))
            return OK
        lines = spark.read.text(a.probe_file) if a.probe_file else spark.createDataFrame([(x,) for x in a.probe], "value string")
        lines = lines.select(F.monotonically_increasing_id().alias("ord"), L.as_bytes(F.col("value")).alias("line"))
        for r in probe(spark, lines, net, tables, a.probe_int16).orderBy("ord").toLocalIterator():
            log.info("%d", r["score"])
        return OK
    how = S.Labels(a.lam, a.k, a.holdout, a.max_lines)
    found = discovery.Found(a.corpus or None, tuple(a.data), ()) if a.data or a.corpus else discovery.discover(spark, v, discovery.roots(*a.root))
    if found.packed:
        corpus = load_packed(spark, found.packed, v, a.k)
    elif found.globs:
        corpus = load_text(spark, found.globs, v, how, a.group_key, tables)
    else:
        raise ValueError(f"no {v.name} data found")
    log.info(S.summary(corpus.stats, a.lam))
    if a.pack:
        packed.write(a.out_corpus or f"{v.name}.ntc", v, corpus.samples, corpus.stats, how)
        return OK
    log.info("anchor alone: valid MSE %.6f", networks.anchor_mse(corpus.samples, corpus.k).first()["mse"])
    if a.eval_only:
        _, told = ship(corpus.samples, weights.read(a.load, v), corpus.k)
        log.info("valid MSE %.6f", told["mse"])
        return OK
    o = training.ONLINE if a.algo == "online" else training.MINIBATCH
    given = {"epochs": a.epochs, "batch": a.batch, "lr": a.lr, "optimizer": a.opt, "schedule": a.lr_schedule, "warmup": a.warmup_epochs, "seed": a.seed}
    o = dataclasses.replace(o, **{k: x for k, x in given.items() if x is not None})
    net = networks.new(v, a.h or v.fixed_h or 128, a.buckets, a.seed)
    fit = training.online if a.algo == "online" else training.minibatch
    net = fit(corpus.samples, net, corpus.k, o, lambda epoch, mse, lr: log.info("epoch %d: valid MSE %.6f (lr %.2e)", epoch, mse, lr))
    small, told = ship(corpus.samples, net, corpus.k)
    log.info("quantized: valid MSE %.6f, accumulators %d to %d", told["mse"], told["lo"], told["hi"])
    if not told["fits"]:
        return OVERFLOW
    if a.out:
        weights.write(a.out, small)
    if a.outh:
        with open(a.outh, "w") as f:
            f.write(weights.header(small))
    if a.out_netbin:
        with open(a.out_netbin, "wb") as f:
            f.write(weights.net_bin(net))
    return OK


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    log.setLevel(logging.INFO)
    handlers = [logging.StreamHandler(sys.stdout)] + ([logging.FileHandler(a.log)] if a.log else [])
    for h in handlers:
        h.setFormatter(logging.Formatter("%(message)s"))
        log.addHandler(h)
    try:
        if a.list_variants:
            log.info(list_variants())
            return OK
        return run(a, spark or SparkSession.builder.getOrCreate())
    except (ValueError, OSError) as e:
        print(f"trainer: {e}", file=sys.stderr)
        return USAGE
    finally:
        for h in handlers:
            log.removeHandler(h)
            h.flush()


if __name__ == "__main__":
    sys.exit(main())
