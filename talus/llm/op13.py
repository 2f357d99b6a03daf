"""Query op13: all conversations damaged by rule and repaired again."""

from pyspark.sql import functions as F

from talus.llm.conversations import damaged, repaired
from talus.session import table


def op13_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    found = repaired(damaged(rows)).withColumnRenamed("conv_id", "found")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select(
        "conv_id",
        *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256"),
    )


def _before(value: str, cost: str, label: str, line: str = "NULL") -> str:
    """SQL of a path one edit longer at its front."""
    joined = value + ".b" if line == "NULL" else f"CASE WHEN {value}.b IS NULL THEN {line} ELSE {line} || chr(10) || {value}.b END"
    return f"CASE WHEN {value} IS NOT NULL THEN struct_pack(c := {value}.c + {cost}, l := '{label}' || {value}.l, b := {joined}) END"


def _least(*values: str) -> str:
    return f"list_sort(list_filter([{', '.join(values)}], lambda x: x IS NOT NULL))[1]"


def _row(state: str) -> str:
    """SQL of the cheapest ways to read the current row in a grammar state: delete, keep or another role."""
    moves = {"o": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state]
    ways = [_before(f"v{state}", "2", "D")]
    stays = "fault NOT IN ('blank', 'duplicate')"
    more = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    for initial, to in moves.items():
        ways.append(f"CASE WHEN {stays} AND left(role, 1) = '{initial}' THEN {_before(f'v{to}', more, 'K', 'role || chr(58) || text')} END")
        if to in "ua":
            name = {"u": "user", "a": "assistant"}[to]
            ways.append(f"CASE WHEN {stays} THEN {_before(f'v{to}', f'1 + {more}', 'R', f'$q${name}:$q$ || text')} END")
    return _least(*ways)


_INSERT = {to: lambda v, n=name: _before(v, "5", "I", f"'{n}:'") for to, name in (("u", "user"), ("a", "assistant"))}
SQL = rf"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384::BIGINT * (c & 1)))),
           4294967295::BIGINT) % 20 AS draw
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE draw != 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM hurt),
faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM faulty GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS left_over, {{'c': 0::BIGINT, 'l': '', 'b': NULL::VARCHAR}} AS vo, {{'c': 10::BIGINT, 'l': 'II', 'b': 'user:' || chr(10) || 'assistant:'}} AS vs,
         {{'c': 5::BIGINT, 'l': 'I', 'b': 'assistant:'}} AS vu, {{'c': 0::BIGINT, 'l': '', 'b': NULL::VARCHAR}} AS va
  FROM counted
  UNION ALL
  SELECT conv_id, left_over, {_least("ro", _INSERT["u"]("xu"))}, {_least("rs", _INSERT["u"]("xu"))}, xu, xa
  FROM (
    SELECT conv_id, left_over, ro, rs, {_least("ru", _INSERT["a"]("ra"))} AS xu, {_least("ra", _INSERT["u"]("ru"))} AS xa
    FROM (
      SELECT w.conv_id, left_over - 1 AS left_over, {_row("o")} AS ro, {_row("s")} AS rs, {_row("u")} AS ru, {_row("a")} AS ra
      FROM walk AS w JOIN faulty AS f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = w.left_over))),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(vo.c, 0) AS cost, coalesce(vo.l, '') AS audit, sha256(coalesce(vo.b, '')) AS repaired_sha256
FROM ids LEFT JOIN counted ON ids.conv_id IS NOT DISTINCT FROM counted.conv_id
LEFT JOIN walk ON ids.conv_id IS NOT DISTINCT FROM walk.conv_id AND left_over = 0
"""

QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLES = {"op13_conversation_repair": SQL}
