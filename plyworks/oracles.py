"""SQL for DuckDB, written from the rules of each operator, against which the registered queries are held."""

from __future__ import annotations

from plyworks import synthetic

# Rules by variant, as (squares of a cell, features' stride, king's worth, bucket by pieces, skipped boards).
_DARK = "CASE WHEN ((i // 8) + (i % 8)) % 2 = 1 THEN 4 * (i // 8) + (i % 8) // 2 END"
_PHASES = "CASE WHEN n >= 20 THEN 0 WHEN n >= 14 THEN 1 WHEN n >= 8 THEN 2 ELSE 3 END"
_RULES = {
    "filipino": (_DARK, 32, 320, _PHASES, "x + o <= 5"),
    "brazilian": (_DARK, 32, 320, _PHASES, "x + o <= 0"),
    "english": (_DARK, 32, 150, "0", "least(x, o) <= 1 AND greatest(x, o) <= 3"),
    "russian": (_DARK, 32, 320, "0", "false"),
    "turkish": ("i", 64, 320, "CASE WHEN n >= 26 THEN 0 WHEN n >= 18 THEN 1 WHEN n >= 10 THEN 2 ELSE 3 END", "x + o <= 2"),
}


def _fnv(text: str, seed: str = "2166136261::BIGINT") -> str:
    return f"list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, {seed})"


def _parsed(v: str = "filipino") -> str:
    """CTEs up to parsed: a row for each line, with what its tokens say."""
    return (
        synthetic.SQL
        + f""",
tok AS (SELECT file_idx, ord, list_filter(string_split_regex(line, '[ \t\r]+'), lambda t: t <> '')[1:5] AS p FROM selfplay),
cut AS (SELECT *, len(p) >= 3 AND strlen(p[1]) = 64 AS accepted, p[1] AS board,
  len(p[1]) - len(replace(p[1], 'X', '')) + len(p[1]) - len(replace(p[1], 'K', '')) AS x,
  len(p[1]) - len(replace(p[1], 'O', '')) + len(p[1]) - len(replace(p[1], 'Q', '')) AS o FROM tok),
parsed AS (SELECT file_idx, ord, p, board, accepted, accepted AND ({_RULES[v][4]}) AS tb_skip,
  regexp_replace(board, '[^.XOKQ]', '?', 'g') AS key, p[4] AS gid,
  CASE p[3] WHEN 'X' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS outcome,
  CASE WHEN regexp_full_match(p[5], '[+-]?[0-9]+') THEN TRY_CAST(p[5] AS BIGINT) END AS eval FROM cut)"""
    )


def _features(v: str, source: str) -> str:
    """A CTE feat with the key's features as a list, its anchor and bucket."""
    square, stride, king, bucket, _ = _RULES[v]
    return f""",
cells AS (SELECT i, {square} AS s FROM range(0, 64) t(i)),
pieces AS (SELECT key, i, instr('XOKQ', substr(key, i + 1, 1)) - 1 AS plane, s FROM (SELECT DISTINCT key FROM {source}) k, cells WHERE s IS NOT NULL AND instr('XOKQ', substr(key, i + 1, 1)) > 0),
owned AS (SELECT key, list(plane * {stride} + s ORDER BY i) AS f, count(*) AS n, sum(CASE plane WHEN 0 THEN 100 WHEN 1 THEN -100 WHEN 2 THEN {king} ELSE -{king} END) AS anchor FROM pieces GROUP BY key),
feat AS (SELECT k.key, coalesce(f, []) AS f, coalesce(n, 0) AS n, coalesce(anchor, 0)::BIGINT AS anchor FROM (SELECT DISTINCT key FROM {source}) k LEFT JOIN owned USING (key)),
"""


_GROUPS = f""",
hashed AS (SELECT *, CASE WHEN gid IS NULL THEN {_fnv("'b:' || board")} ELSE {_fnv("'filipino/w' || file_idx || '.txt:' || gid")} END AS hash FROM parsed WHERE accepted AND NOT tb_skip),
grp AS (SELECT key, min(ord) AS first_ord, arg_min(hash, ord) AS hash, count(*) AS n, avg(outcome) AS outcome, count(eval) AS n_eval, avg(eval) AS eval FROM hashed GROUP BY key),
labelled AS (SELECT *, CASE WHEN n_eval > 0 THEN 0.5 / (1 + exp(-(eval / 256))) + 0.5 * outcome ELSE outcome END AS y, hash % 20 = 0 AS is_valid FROM grp)"""

_GROUPED = _parsed() + _GROUPS
_SAMPLES = _GROUPED + _features("filipino", "labelled") + f"samples AS (SELECT l.*, f, feat.n AS pieces, anchor, {_PHASES.replace('n >=', 'feat.n >=')} AS bucket FROM labelled l JOIN feat USING (key))"

_PER_FILE = """
SELECT file_idx, count(DISTINCT CASE WHEN accepted THEN gid END) AS games, count(*) FILTER (accepted) AS lines,
  count(DISTINCT CASE WHEN accepted AND NOT tb_skip THEN key END) AS "unique", count(*) FILTER (NOT accepted) AS malformed,
  count(*) FILTER (tb_skip) AS tbskip, count(*) FILTER (accepted AND gid IS NULL) AS nogameid FROM parsed GROUP BY file_idx"""
_TOTAL = """SELECT count(DISTINCT file_idx) AS files, count(DISTINCT CASE WHEN accepted AND gid IS NOT NULL THEN file_idx || ':' || gid END) AS games, count(*) FILTER (accepted) AS lines,
  count(DISTINCT CASE WHEN accepted AND NOT tb_skip THEN key END) AS "unique", count(*) FILTER (NOT accepted) AS malformed,
  count(*) FILTER (tb_skip) AS tbskip, count(*) FILTER (accepted AND gid IS NULL) AS nogameid FROM parsed"""

# A network of arithmetic weights: 8 units, W1 by feature, W2 by bucket.
_W1, _B1, _W2 = "((f * 31 + j * 17) % 61 - 30)", "((j * 7) % 11 - 3)", "((b * 13 + j * 29) % 101 - 50)"
_ROUND = "(CASE WHEN {0} < 0 THEN -floor(0.5 - ({0})) ELSE floor(({0}) + 0.5) END)"
_UNITS = """,
units AS (SELECT j FROM range(0, 8) t(j)),
ex AS (SELECT first_ord, unnest(f) AS f FROM samples),
own AS (SELECT first_ord, j, sum({w1}) AS a FROM ex, units GROUP BY ALL),
other AS (SELECT first_ord, j, sum({w1}) AS a FROM (SELECT first_ord, xor(f // 32, 1) * 32 + 31 - f % 32 AS f FROM ex), units GROUP BY ALL),
acc AS (SELECT s.first_ord, s.bucket AS b, units.j, {b1} + coalesce(own.a, 0) AS a1, {b1} + coalesce(other.a, 0) AS a2
  FROM samples s CROSS JOIN units LEFT JOIN own ON own.first_ord = s.first_ord AND own.j = units.j LEFT JOIN other ON other.first_ord = s.first_ord AND other.j = units.j)"""
_FLOAT = _SAMPLES + _UNITS.format(w1=_W1 + " / 100.0::DOUBLE", b1=_B1.replace("j", "units.j") + " / 20.0::DOUBLE") + f""",
net AS (SELECT first_ord, 64 * sum({_W2} / 100.0::DOUBLE * (greatest(least(a1, 1), 0) - greatest(least(a2, 1), 0))) AS net FROM acc GROUP BY first_ord)"""
_Q1, _Q2 = _ROUND.format(_W1 + " * 256 / 100.0::DOUBLE"), _ROUND.format(_W2 + " * 256 / 100.0::DOUBLE")
_INT = _SAMPLES + _UNITS.format(w1=_Q1 + "::BIGINT", b1="(" + _ROUND.format(_B1.replace("j", "units.j") + " * 256 / 20.0::DOUBLE") + ")::BIGINT") + f""",
net AS (SELECT first_ord, trunc(sum({_Q2}::BIGINT * (greatest(least(a1, 256), 0) - greatest(least(a2, 256), 0))) / 64.0::DOUBLE)::BIGINT AS score FROM acc GROUP BY first_ord)"""
_MSE = "SELECT round(avg(pow(y - 1 / (1 + exp(-(anchor + {0}) / 256.0::DOUBLE)), 2)), {1}) AS mse FROM samples {2} WHERE is_valid"

# Chess positions by rule, from orders.
_CHESS = """
WITH raw AS (SELECT o_orderkey AS id, o_custkey AS c,
  ['rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR', 'r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R', '8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8', 'r4rk1/1pp1qppp/p1np1n2/2b1p1B1/2B1P1b1/P1NP1N2/1PP1QPPP/R4RK1', 'rk2r3/pppppppp/8/8/8/8/PPPPPPPP/RK2R3', '4k3/8/8/3pP3/8/8/8/4K2R', 'b3k2b/1p4p1/8/8/8/8/1P4P1/B3K2B', '8/8/8/8/8/8/8/K6k', 'rnbqkbnr/pppppppp/9/8/8/8/PPPPPPPP/RNBQKBNR', 'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPP/RNBQKBNR', 'rnbq1bnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR'] AS places,
  ['-', 'KQkq', 'Kq', 'Aa', 'Ee', 'x'] AS rights, ['-', 'd6', 'e3', 'i9'] AS passant, ['1-0', '0-1', '1/2-1/2', '*'] AS results FROM orders),
picked AS (SELECT id, c, places[id % 11 + 1] AS placement, CASE WHEN c % 2 = 0 THEN 'w' ELSE 'b' END AS stm, rights[(id + c) % 6 + 1] AS castling, passant[c % 4 + 1] AS ep,
  (id % 100)::VARCHAR AS half, (c % 50 + 1)::VARCHAR AS fullm, results[(id + c * 3) % 4 + 1] AS result, (id % 300)::VARCHAR AS gid, CASE WHEN id % 3 = 0 THEN c % 900 - 450 END AS ev FROM raw),
spread AS (SELECT *, string_split(list_reduce(range(1, 9), lambda s, n: replace(s, n::VARCHAR, repeat('.', n::INT)), placement), '/') AS ranks FROM picked),
board AS (SELECT *, array_to_string(list_reverse(ranks), '') AS squares FROM spread
  WHERE len(ranks) = 8 AND len(list_filter(ranks, lambda r: len(r) <> 8)) = 0 AND regexp_full_match(placement, '[1-8pnbrqkPNBRQK/]+') AND ep <> 'i9' AND castling <> 'x'),
kinged AS (SELECT *, (instr(squares, 'K') - 1) % 8 AS wf, (instr(squares, 'k') - 1) % 8 AS bf, substr(squares, 1, 8) AS r1, substr(squares, 57, 8) AS r8 FROM board
  WHERE len(squares) - len(replace(squares, 'K', '')) = 1 AND len(squares) - len(replace(squares, 'k', '')) = 1),
rooked AS (SELECT *,
  CASE WHEN instr(reverse(r1), 'R') > 0 AND 8 - instr(reverse(r1), 'R') > wf THEN 8 - instr(reverse(r1), 'R') END AS wr, CASE WHEN instr(r1, 'R') > 0 AND instr(r1, 'R') - 1 < wf THEN instr(r1, 'R') - 1 END AS wl,
  CASE WHEN instr(reverse(r8), 'r') > 0 AND 8 - instr(reverse(r8), 'r') > bf THEN 8 - instr(reverse(r8), 'r') END AS br, CASE WHEN instr(r8, 'r') > 0 AND instr(r8, 'r') - 1 < bf THEN instr(r8, 'r') - 1 END AS bl FROM kinged),
pos AS (SELECT *,
  CASE castling WHEN 'KQkq' THEN wr WHEN 'Kq' THEN wr WHEN 'Aa' THEN CASE WHEN 0 > wf THEN 0 END WHEN 'Ee' THEN CASE WHEN 4 > wf THEN 4 END END AS wk,
  CASE castling WHEN 'KQkq' THEN wl WHEN 'Aa' THEN CASE WHEN 0 <= wf THEN 0 END WHEN 'Ee' THEN CASE WHEN 4 <= wf THEN 4 END END AS wq,
  CASE castling WHEN 'KQkq' THEN br WHEN 'Aa' THEN CASE WHEN 0 > bf THEN 0 END WHEN 'Ee' THEN CASE WHEN 4 > bf THEN 4 END END AS bk,
  CASE castling WHEN 'KQkq' THEN bl WHEN 'Kq' THEN bl WHEN 'Aa' THEN CASE WHEN 0 <= bf THEN 0 END WHEN 'Ee' THEN CASE WHEN 4 <= bf THEN 4 END END AS bq FROM rooked
  WHERE (castling <> 'KQkq' OR (wr IS NOT NULL AND wl IS NOT NULL AND br IS NOT NULL AND bl IS NOT NULL)) AND (castling <> 'Kq' OR (wr IS NOT NULL AND bl IS NOT NULL))),
feats AS (SELECT id, i, instr('PNBRQKpnbrqk', substr(squares, i + 1, 1)) - 1 AS k, stm FROM pos, range(0, 64) t(i) WHERE substr(squares, i + 1, 1) <> '.'),
rel AS (SELECT id, k, i, CASE WHEN (stm = 'b') = (k >= 6) THEN 0 ELSE 384 END + (k % 6) * 64 + xor(i, CASE WHEN stm = 'b' THEN 56 ELSE 0 END) AS f FROM feats)
"""
_USUAL = "coalesce(wk = 7 AND wf = 4, true) AND coalesce(wq = 0 AND wf = 4, true) AND coalesce(bk = 7 AND bf = 4, true) AND coalesce(bq = 0 AND bf = 4, true)"
_LETTERS = f"""CASE WHEN {_USUAL} THEN CASE WHEN wk IS NOT NULL THEN 'K' ELSE '' END || CASE WHEN wq IS NOT NULL THEN 'Q' ELSE '' END || CASE WHEN bk IS NOT NULL THEN 'k' ELSE '' END || CASE WHEN bq IS NOT NULL THEN 'q' ELSE '' END
  ELSE coalesce(chr((65 + wk)::INT), '') || coalesce(chr((65 + wq)::INT), '') || coalesce(chr((97 + bk)::INT), '') || coalesce(chr((97 + bq)::INT), '') END"""
_FILES = "|| ".join(f"coalesce({x}::VARCHAR, '-') " for x in ("wk", "wq", "bk", "bq"))
_CQ1 = _ROUND.format("((f * 31 + j * 17) % 61 - 30) * 255 / 100.0::DOUBLE")

SQL = {
    "tokenize": _parsed() + "SELECT ord, len(p) AS n_tokens, array_to_string(p, '|') AS tokens FROM tok",
    "parsed_lines": _parsed() + "SELECT ord, gid, outcome, eval, key, tb_skip::INT AS tb_skip FROM parsed WHERE accepted",
    "accept_split": _parsed() + "SELECT file_idx, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS malformed FROM parsed GROUP BY file_idx",
    "counts": _parsed() + "SELECT ord, " + ", ".join(f"(len(board) - len(replace(board, '{g}', '')))::BIGINT AS {n}" for g, n in zip("XOKQ", ("x_men", "o_men", "x_kings", "o_kings"))) + " FROM cut",
    "inv_per_file": _parsed() + _PER_FILE,
    "inv_total": _parsed() + f'SELECT *, round(CASE WHEN "unique" > 0 THEN lines / "unique"::DOUBLE ELSE 0 END, 9) AS dedup FROM ({_TOTAL})',
    "inv_games": _parsed() + "SELECT file_idx, count(DISTINCT gid) AS games FROM parsed WHERE accepted GROUP BY file_idx",
    "inv_unique": _parsed() + 'SELECT file_idx, count(DISTINCT key) AS "unique" FROM parsed WHERE accepted AND NOT tb_skip GROUP BY file_idx',
    "rollup_total": _parsed()
    + f""", english AS (SELECT * REPLACE (accepted AND least(x, o) <= 1 AND greatest(x, o) <= 3 AS tb_skip) FROM (SELECT parsed.*, cut.x, cut.o FROM parsed JOIN cut USING (file_idx, ord))),
russian AS (SELECT * REPLACE (false AS tb_skip) FROM parsed),
a AS ({_TOTAL}), b AS ({_TOTAL.replace("FROM parsed", "FROM english")}), c AS ({_TOTAL.replace("FROM parsed", "FROM russian")}),
alln AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT (sum(files) + (SELECT files FROM a))::BIGINT AS files, sum(games)::BIGINT AS games, (sum(lines) + (SELECT lines FROM a))::BIGINT AS lines, (sum("unique") + (SELECT "unique" FROM a))::BIGINT AS "unique",
  sum(malformed)::BIGINT AS malformed, (sum(tbskip) + (SELECT tbskip FROM a))::BIGINT AS tbskip, sum(nogameid)::BIGINT AS nogameid FROM alln""",
    "mirror_features": _parsed() + ", acc AS (SELECT * FROM parsed WHERE accepted)" + _features("filipino", "acc")
    + "m AS (SELECT key, array_to_string(list_sort(list_transform(f, lambda x: xor(x // 32, 1) * 32 + 31 - x % 32)), ',') AS mirrored FROM feat) SELECT key, translate(reverse(key), 'XOKQ', 'OXQK') AS mirror_board, mirrored FROM m",
    "padded_features": _SAMPLES + "SELECT first_ord, array_to_string(list_concat(f, list_transform(range(0, greatest(32 - len(f), 0)), lambda x: 128)), ',') AS padded FROM samples",
    "bucket_hist": _SAMPLES + "SELECT bucket::BIGINT AS bucket, count(*) AS n, sum(anchor)::BIGINT AS anchor_sum FROM samples GROUP BY bucket",
    "dedup_first_seen": _GROUPED + "SELECT key, first_ord, n, n_eval FROM grp",
    "avg_outcome": _GROUPED + "SELECT key, round(outcome, 9) AS outcome, round(eval, 9) AS eval FROM grp",
    "eval_blend": _GROUPED + "SELECT first_ord, round(y, 9) AS y, n, n_eval FROM labelled",
    "fnv_group_hash": _GROUPED + "SELECT first_ord, hash FROM grp",
    "holdout_split": _GROUPED + "SELECT first_ord, is_valid::INT AS is_valid FROM labelled",
    "loader_stats": _GROUPED + """SELECT (SELECT count(*) FROM parsed WHERE accepted) AS lines, count(*) AS "unique", count(*) FILTER (NOT is_valid) AS train, count(*) FILTER (is_valid) AS valid,
  (SELECT count(*) FROM parsed WHERE tb_skip) AS tbskip, count(*) FILTER (n_eval > 0) AS evalpos, 20::BIGINT AS holdout FROM labelled""",
    "max_lines": _parsed() + "SELECT ord, tb_skip::INT AS tb_skip FROM parsed WHERE accepted ORDER BY ord LIMIT 1000",
    "csr_offsets": _SAMPLES + "SELECT first_ord, (sum(len(f)) OVER w - len(f))::BIGINT AS off, (sum(len(f)) OVER w)::BIGINT AS \"end\" FROM samples WINDOW w AS (ORDER BY first_ord)",
    "train_order": _GROUPED + "SELECT first_ord, row_number() OVER (ORDER BY first_ord) - 1 AS rank FROM labelled WHERE NOT is_valid",
    "anchor_mse": _SAMPLES + _MSE.format("0", 9, ""),
    "forward_float": _FLOAT + "SELECT first_ord, round(net, 6) AS net FROM net",
    "score16": _INT + "SELECT first_ord, score FROM net",
    "score16_narrow": _INT + "SELECT first_ord, score FROM net",
    "float_mse": _FLOAT + _MSE.format("net", 7, "JOIN net USING (first_ord)"),
    "quant_mse": _INT + _MSE.format("score / 16.0::DOUBLE", 7, "JOIN net USING (first_ord)"),
    "acc_bound": _INT + "SELECT least(0, min(a1))::BIGINT AS lo, greatest(0, max(a1))::BIGINT AS hi FROM acc",
    "quantize": f"SELECT f, j, greatest(least({_Q1}, 32000), -32000)::BIGINT AS w1 FROM range(0, 128) a(f), range(0, 8) b(j)",
    "grad_step": _FLOAT + f""", out AS (SELECT first_ord, bucket, y, 1 / (1 + exp(-(anchor + net) / 256.0::DOUBLE)) AS p FROM samples JOIN net USING (first_ord) WHERE NOT is_valid),
grid AS (SELECT b, j FROM range(0, 4) x(b), range(0, 8) z(j)),
got AS (SELECT acc.b, acc.j, sum(-2 * (y - p) * p * (1 - p) / 4.0::DOUBLE * (greatest(least(a1, 1), 0) - greatest(least(a2, 1), 0))) AS d FROM out JOIN acc USING (first_ord) GROUP BY ALL)
SELECT b AS bucket, j, round(coalesce(d, 0), 6) AS dw2 FROM grid LEFT JOIN got USING (b, j)""",
    "lr_schedule": "SELECT e AS epoch, round(CASE WHEN e = 1 THEN 0.001 / 2 ELSE 0.001 * 0.5 * (1 + cos(pi() * (e - 2) / 39.0::DOUBLE)) END, 12) AS lr FROM range(1, 41) t(e)",
    "fen_placement": _CHESS + "SELECT id, squares, len(replace(squares, '.', '')) AS pieces FROM pos",
    "fen_round_trip": _CHESS + f"""SELECT id, placement || ' ' || stm || ' ' || CASE WHEN {_LETTERS} = '' THEN '-' ELSE {_LETTERS} END || ' ' || ep || ' ' || half || ' ' || fullm AS fen,
  squares || '|' || stm || '|' || {_FILES} || '|' || CASE ep WHEN 'd6' THEN '3' WHEN 'e3' THEN '4' ELSE '-' END AS key FROM pos""",
    "chess_features": _CHESS + "SELECT id, string_agg(f::VARCHAR, ',' ORDER BY k, i) AS features FROM rel GROUP BY id",
    "chess_flip": _CHESS + """, won AS (SELECT *, CASE result WHEN '1-0' THEN 1.0::DOUBLE WHEN '0-1' THEN 0.0::DOUBLE WHEN '1/2-1/2' THEN 0.5::DOUBLE END AS w FROM pos)
SELECT id AS ord, gid, CASE WHEN stm = 'b' THEN 1 - w ELSE w END AS outcome, CASE WHEN stm = 'b' THEN -ev ELSE ev END AS eval FROM won WHERE w IS NOT NULL""",
    "score_cp": _CHESS + f""", units AS (SELECT j FROM range(0, 8) t(j)),
sums AS (SELECT id, j, sum({_CQ1}::BIGINT) AS s FROM rel, units GROUP BY ALL),
acc AS (SELECT id, j, {_ROUND.format("((j * 7) % 11 - 3) * 255 / 20.0::DOUBLE")}::BIGINT + s AS a FROM sums),
net AS (SELECT id, 4080 + sum(greatest(least(a, 255), 0) * {_ROUND.format("((j * 29) % 101 - 50) * 64 / 100.0::DOUBLE")}::BIGINT) AS o FROM acc GROUP BY id)
SELECT id, CASE WHEN o >= 0 THEN (o + 8160) // 16320 ELSE -((8160 - o) // 16320) END::BIGINT AS score FROM net""",
}
for _v in _RULES:
    SQL[f"tbskip_{_v}"] = _parsed(_v) + "SELECT file_idx, count(*) FILTER (tb_skip) AS tbskip FROM parsed GROUP BY file_idx"
    SQL[f"features_{_v}"] = _parsed(_v) + ", acc AS (SELECT * FROM parsed WHERE accepted)" + _features(_v, "acc").rstrip().rstrip(",") + f" SELECT key, array_to_string(f, ',') AS features, anchor, ({_RULES[_v][3]})::BIGINT AS bucket FROM feat"
