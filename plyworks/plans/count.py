"""The inventory command: counts every variant's corpus and prints a table or JSON.

Exit codes: 0 counted, 1 a file could not be read, 2 usage, 5 no data anywhere.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from plyworks.operators import inventory
from plyworks.operators.parse import parse
from plyworks.sources import discovery, packed, text
from plyworks.variants import VARIANTS, Variant, get

OK, UNREADABLE, USAGE, NO_DATA = 0, 1, 2, 5
TEXT, PACKED = "text", "packed(.ntc)"


@dataclass
class FileRow:
    path: str
    games: int | None
    lines: int
    unique: int | None
    malformed: int | None
    tbSkip: int
    error: str = ""


@dataclass
class Row:
    """Counters of one variant; None is unknown, which isn't zero."""

    variant: str
    source: str = ""
    files: int = 0
    games: int | None = 0
    lines: int = 0
    unique: int | None = 0
    malformed: int | None = 0
    tbSkip: int = 0
    noGameId: int = 0
    exactUnique: bool = True
    perFile: list[FileRow] = field(default_factory=list)


def count_packed(path: str, v: Variant) -> Row:
    """What a header says. It has neither games nor malformed lines."""
    info = packed.read_header(path)
    if info.name != v.name:
        raise ValueError(f"{path} holds variant {info.name!r}, not {v.name!r}")
    one = FileRow(path, None, info.lines, info.unique, None, info.tbskip)
    return Row(v.name, PACKED, 1, None, info.lines, info.unique, None, info.tbskip, perFile=[one])


def count_text(spark: SparkSession, globs, v: Variant, unique: bool = True) -> Row:
    """Counts text files. The files' counters are one pass, and the totals their sums; unique positions over several files, always exact, take a pass of keys alone."""
    files = discovery.expand(spark, globs)
    lines = text.read_lines(spark, files, v)
    cut = {r["file_idx"] for r in text.first_long(lines).collect()}
    parsed = parse(text.until_long(lines) if cut else lines, v)
    table = discovery.files_table(spark, files, v)
    each = {r["file_idx"]: r for r in inventory.per_file(parsed, table, unique).collect()}
    whole = {c: sum(r[c] for r in each.values()) for c in ("games", "lines", "malformed", "tbskip", "nogameid")}
    positions = None if not unique else inventory.unique(parsed) if len(each) > 1 else sum(r["unique"] for r in each.values())
    rows = [FileRow(f.path, each[i]["games"], each[i]["lines"], each[i]["unique"], each[i]["malformed"], each[i]["tbskip"], "a line is too long" if i in cut else "") for i, f in enumerate(files)]
    return Row(v.name, TEXT, len(files), whole["games"], whole["lines"], positions, whole["malformed"], whole["tbskip"], whole["nogameid"], perFile=rows)


def total(rows: list[Row]) -> Row:
    """The sum. Games and malformed lines are unknown only if no row knows them, unique positions if any row doesn't."""
    known = lambda name: [x for r in rows if (x := getattr(r, name)) is not None]
    some = lambda name: sum(known(name)) if known(name) or not rows else None
    plain = lambda name: sum(getattr(r, name) for r in rows)
    unique = sum(known("unique")) if len(known("unique")) == len(rows) else None
    return Row("TOTAL", "", plain("files"), some("games"), plain("lines"), unique, some("malformed"), plain("tbSkip"), plain("noGameId"))


def comma(n: int | None) -> str:
    return "-" if n is None or n < 0 else f"{n:,}"


def as_json(rows: list[Row], no_data: list[str], errors: list[str], per_file: bool) -> str:
    """The report as JSON; unknown numbers are -1, and empty lists null."""
    plain = lambda d: {k: -1 if x is None else x for k, x in d.items() if not (k == "error" and not x)}

    def one(r: Row) -> dict:
        out = plain(asdict(r) | {"perFile": None})
        out.pop("perFile")
        return out | ({"perFile": [plain(asdict(f)) for f in r.perFile]} if per_file and r.perFile else {})

    report = {"variants": [one(r) for r in rows] or None, "total": one(total(rows)), "noData": no_data or None, "errors": errors or None}
    return json.dumps(report, indent=2)


def as_table(rows: list[Row], no_data: list[str], errors: list[str], per_file: bool, unique: bool) -> str:
    shape = "{:<14} {:<13} {:>5} {:>12} {:>14} {:>14} {:>6} {:>11} {:>11}"
    out = [shape.format("VARIANT", "SOURCE", "FILES", "GAMES", "LINES", "UNIQUE", "DEDUP", "MALFORMED", "TB-SKIP")]
    whole = total(rows)
    for r in [*rows, whole]:
        dedup = f"{r.lines / r.unique:.1f}x" if r.unique and r.lines else "-"
        out.append(shape.format(r.variant, r.source, r.files, comma(r.games), comma(r.lines), comma(r.unique), dedup, comma(r.malformed), comma(r.tbSkip)))
    out += ["", "MALFORMED lines are not in LINES; TB-SKIP lines are in LINES but not in UNIQUE.", "GAMES are distinct game ids within each file, summed."]
    if not unique:
        out.append("UNIQUE and DEDUP were not asked for.")
    if any(r.source == PACKED for r in rows):
        out.append("Packed rows come from the file's header, which has no games and no malformed lines.")
    if whole.noGameId:
        out.append(f"{comma(whole.noGameId)} accepted lines have no game id; their games are not in GAMES.")
    out.append("UNIQUE of the total is the sum of the variants' own.")
    if no_data:
        out.append(f"no data: {' '.join(no_data)}")
    for r in rows if per_file else []:
        out += ["", f"{r.variant}  (UNIQUE is within a file; it doesn't sum to {comma(r.unique)})", f"  {'FILE':<52} {'GAMES':>8} {'LINES':>10} {'UNIQUE':>10} {'MALFORMED':>10} {'TB-SKIP':>10}"]
        for f in r.perFile:
            name = os.path.join(os.path.basename(os.path.dirname(f.path)), os.path.basename(f.path))
            out.append(f"  {name:<52} {comma(f.games):>8} {comma(f.lines):>10} {comma(f.unique):>10} {comma(f.malformed):>10} {comma(f.tbSkip):>10}")
            out += [f"  {'':<52} READ FAILED: {f.error}"] if f.error else []
    if errors:
        out += ["", f"{len(errors)} file(s) could not be read; the counts are incomplete:", *(f"  {e}" for e in errors)]
    return "\n".join(out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser("count")
    p.add_argument("--variant", default="", help="names, joined by commas; all that have data by default")
    p.add_argument("--data", action="append", default=[], help="glob of text files, may be repeated; needs one variant")
    p.add_argument("--corpus", default="", help="packed corpus; needs one variant")
    p.add_argument("--root", action="append", default=[], help="where to look for data, may be repeated")
    p.add_argument("--files", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--no-unique", action="store_true")
    try:
        a = p.parse_args(argv)
        names = [n.strip() for n in a.variant.split(",") if n.strip()]
        wanted = [get(n) for n in names] or list(VARIANTS.values())
        if a.data and a.corpus:
            raise ValueError("--corpus and --data exclude each other")
        if (a.data or a.corpus) and len(wanted) != 1:
            raise ValueError("--data and --corpus need exactly one --variant")
    except SystemExit as e:
        return USAGE if e.code else OK
    except ValueError as e:
        print(f"count: {e}", file=sys.stderr)
        return USAGE
    spark = spark or SparkSession.builder.getOrCreate()
    rows, no_data, errors, places = [], [], [], discovery.roots(*a.root)
    for v in wanted:
        found = discovery.Found(a.corpus or None, tuple(a.data), ()) if a.data or a.corpus else discovery.discover(spark, v, places)
        if not found.packed and not found.globs:
            if names:
                print(f"count: no {v.name} data found in {', '.join(places)}", file=sys.stderr)
                return USAGE
            no_data.append(v.name)
            continue
        try:
            rows.append(count_packed(found.packed, v) if found.packed else count_text(spark, found.globs, v, not a.no_unique))
        except (OSError, ValueError) as e:
            if names:
                print(f"count: {e}", file=sys.stderr)
                return USAGE
            errors.append(f"{v.name}: {e}")
    errors += [f"{f.path}: {f.error}" for r in rows for f in r.perFile if f.error]
    if not rows and not errors:
        print(as_json(rows, no_data, errors, False) if a.json else f"no data found in any variant; looked in {', '.join(places)}")
        return NO_DATA
    print(as_json(rows, no_data, errors, a.files) if a.json else as_table(rows, no_data, errors, a.files, not a.no_unique))
    return UNREADABLE if errors else OK


if __name__ == "__main__":
    sys.exit(main())
