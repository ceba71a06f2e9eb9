"""One query for each operator on derived reads, and the same as DuckDB SQL. All run over the whole tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import adapters as A
from ..functions import expressions as E
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators import rules as R
from ..operators import trimming as T
from ..operators import validation as V
from ..sources import fastq
from . import derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_ADAPTERS = "VALUES " + ", ".join(f"({i}, '{n.replace(chr(39), chr(39) * 2)}', '{s}')" for i, (n, s) in enumerate(A.STANDARD))
WITH = f"WITH reads AS ({derived.READS}), adapters(ord, adapter, seq) AS ({_ADAPTERS}), pairs AS ({derived.PAIRS}), sheet AS ({derived.SHEET}) "
#: Where an oracle goes on with tables of its own.
MORE = WITH.rstrip() + ", "


def reads_query(name: str, oracle: str | None):
    """Registers a function of the derived reads."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(derived.reads(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def pairs_query(name: str, oracle: str | None):
    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(derived.pairs(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sheet_query(name: str, oracle: str):
    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(derived.sheet(spark, sf_dir))
        ORACLES[name] = oracle
        return f

    return add


def _count(col: str, chars: str) -> str:
    return f"(length({col}) - length(translate({col}, '{chars}', '')))"


def _quality_chars(low: int) -> str:
    return "".join(chr(c) for c in range(33 + low, 127)).replace("'", "''")


_HIT = "EXISTS (SELECT 1 FROM adapters a WHERE a.adapter <> CASE read WHEN 'R1' THEN 'TruSeq_R2' ELSE 'TruSeq_R1' END AND instr(sequence, substr(a.seq, 1, 12)) > 0)"

reads_query("basic_stats", MORE + f"""
x AS (SELECT read, length(sequence)::BIGINT AS n, {", ".join(f"{_count('sequence', b + b.lower())}::BIGINT AS {b}" for b in "ACGTN")},
  {_count('quality', _quality_chars(20))}::BIGINT AS q20, {_count('quality', _quality_chars(30))}::BIGINT AS q30, ({_HIT})::BIGINT AS hit FROM reads WHERE length(sequence) > 0)
SELECT read, count(*) AS reads, sum(n)::BIGINT AS bases, min(n) AS min_length, max(n) AS max_length, round(sum(n)::DOUBLE / count(*), 6) AS avg_length,
  {", ".join(f"sum({b})::BIGINT AS n_{b.lower()}" for b in "ACGTN")}, round(100.0::DOUBLE * (sum(G) + sum(C)) / sum(n), 6) AS gc_percent, round(100.0::DOUBLE * sum(x.N) / sum(x.n), 6) AS n_percent,
  round(100.0::DOUBLE * sum(q20) / sum(n), 6) AS q20_percent, round(100.0::DOUBLE * sum(q30) / sum(n), 6) AS q30_percent, sum(hit)::BIGINT AS adapter_reads, round(100.0::DOUBLE * sum(hit) / count(*), 6) AS adapter_percent
FROM x GROUP BY read""".replace("length(sequence)::BIGINT AS n,", "length(sequence)::BIGINT AS len,").replace("sum(n)", "sum(len)").replace("min(n)", "min(len)").replace("max(n)", "max(len)").replace("sum(x.n)", "sum(len)").replace("sum(x.N)", "sum(N)"))(M.basic_statistics)

reads_query("length_distribution", WITH + "SELECT read, length(sequence)::INT AS length, count(*) AS reads FROM reads GROUP BY ALL")(M.length_distribution)

_BASES = """
b AS (SELECT read, unnest(string_split(upper(sequence), '')) AS base, generate_subscripts(string_split(sequence, ''), 1) AS position FROM reads WHERE length(sequence) > 0),
c AS (SELECT read, position::INT AS position, count(*) FILTER (base = 'A') AS n_a, count(*) FILTER (base = 'C') AS n_c, count(*) FILTER (base = 'G') AS n_g, count(*) FILTER (base = 'T') AS n_t, count(*) FILTER (base = 'N') AS n_n, count(*) AS coverage FROM b GROUP BY ALL)
"""
_SHARE = "CASE WHEN {of} > 0 THEN round(100.0::DOUBLE * {x} / {of}, 6) ELSE 0.0 END"
reads_query("base_content_by_position", MORE + _BASES + "SELECT *, " + ", ".join(f"{_SHARE.format(x=f'n_{b}', of='(n_a + n_c + n_g + n_t)')} AS {b}_percent" for b in "acgt") + f", {_SHARE.format(x='n_n', of='coverage')} AS n_percent FROM c")(M.base_content)
reads_query("n_content_by_position", MORE + _BASES + "SELECT read, position, coverage, round(100.0::DOUBLE * n_n / coverage, 6) AS n_percent FROM c")(lambda d: M.base_content(d).select("read", "position", "coverage", "n_percent"))

_HISTOGRAM = """
c AS (SELECT read, unnest(string_split(quality, '')) AS c, generate_subscripts(string_split(quality, ''), 1) AS position FROM reads WHERE length(sequence) > 0),
h AS (SELECT read, position::INT AS position, (ascii(c) - 33)::INT AS q, count(*) AS n FROM c GROUP BY ALL)"""
reads_query("quality_histogram", MORE + _HISTOGRAM + "SELECT * FROM h")(M.quality_histogram)
_POSITION = _HISTOGRAM + """,
e AS (SELECT read, position::INT AS position, ascii(c) - 33 AS q FROM c),
p AS (SELECT read, position, count(*) AS n, round(avg(q), 6) AS mean_quality, CASE WHEN count(*) > 100 THEN quantile_disc(q, 0.25)::INT END AS lower_quartile, CASE WHEN count(*) > 100 THEN quantile_disc(q, 0.5)::INT END AS median FROM e GROUP BY ALL)"""
reads_query("quality_by_position", MORE + _POSITION + "SELECT * FROM p")(lambda d: M.quality_by_position(M.quality_histogram(d)))
_WIDTHS = """,
l AS (SELECT max(position) AS longest FROM p),
wd AS (SELECT min(w) AS w FROM (SELECT unnest([2, 5, 10, 20, 50, 100, 200, 500]) AS w), l WHERE 9 + ceil((longest - 9) / w::DOUBLE) < 75),
g AS (SELECT *, CASE WHEN longest <= 75 OR position < 10 THEN position WHEN w > 10 AND position < w THEN 10 WHEN w > 10 THEN w * (position // w) ELSE 10 + w * ((position - 10) // w) END AS first,
  CASE WHEN longest <= 75 OR position < 10 THEN position WHEN w > 10 AND position < w THEN least(w - 1, longest) WHEN w > 10 THEN least(w * (position // w) + w - 1, longest) ELSE least(10 + w * ((position - 10) // w) + w - 1, longest) END AS last FROM p, l, wd)
"""
reads_query("quality_by_base_group", MORE + _POSITION + _WIDTHS + "SELECT read, first::INT AS first, last::INT AS last, round(avg(mean_quality), 4) AS mean_quality, round(avg(lower_quartile), 4) AS lower_quartile, round(avg(median), 4) AS median FROM g GROUP BY ALL")(
    lambda d: M.quality_by_group(M.quality_by_position(M.quality_histogram(d)))
)
_READ_QUALITY = """
r AS (SELECT read, list_sum(list_transform(string_split(quality, ''), lambda x: ascii(x) - 33))::BIGINT AS s, length(quality) AS n FROM reads WHERE length(sequence) > 0),
a AS (SELECT read, round(s::DOUBLE / n)::INT AS v, count(*) AS k FROM r GROUP BY ALL), t AS (SELECT read, (s // n)::INT AS v, count(*) AS k FROM r GROUP BY ALL),
m AS (SELECT read, max(v) AS top FROM (SELECT read, v FROM a UNION ALL SELECT read, v FROM t) GROUP BY read), dn AS (SELECT read, unnest(range(0, top + 1))::INT AS v FROM m),
rq AS (SELECT dn.read, dn.v AS mean_quality, coalesce(a.k, 0) AS read_count, coalesce(t.k, 0) AS read_count_truncate FROM dn LEFT JOIN a USING (read, v) LEFT JOIN t USING (read, v))"""
reads_query("read_quality_rounded_truncated", MORE + _READ_QUALITY + "SELECT * FROM rq")(M.read_quality)

_GC = f"""
gcn AS (SELECT read, length(sequence)::INT AS length, {_count('sequence', 'GCgc')}::BIGINT AS gc, count(*) AS n FROM reads WHERE length(sequence) > 0 GROUP BY ALL),
gl AS (SELECT DISTINCT length FROM gcn), gg AS (SELECT length, unnest(range(0, length + 1)) AS gc FROM gl),
gp AS (SELECT length, gc, unnest(range(floor(greatest(0.0, gc - 0.5::DOUBLE) * 100.0 / length + 0.5)::BIGINT, floor(least(length::DOUBLE, gc + 0.5::DOUBLE) * 100.0 / length + 0.5)::BIGINT + 1))::INT AS bin FROM gg),
gw AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY length, bin) AS weight FROM gp)"""
reads_query("gc_model_weights", MORE + _GC + "SELECT length, gc, bin, round(weight, 9) AS weight FROM gw")(lambda d: M.gc_weights(M.gc_counts(d)).select("length", "gc", "bin", F.round("weight", 9).alias("weight")))
_GCD = _GC + """,
gr AS (SELECT read, round(gc * 100.0::DOUBLE / length)::INT AS bin, sum(n)::BIGINT AS reads FROM gcn GROUP BY ALL),
gf AS (SELECT read, bin, sum(n * weight) AS observed FROM gcn JOIN gw USING (length, gc) GROUP BY ALL),
gd AS (SELECT k.read, k.bin, coalesce(reads, 0)::BIGINT AS reads, round(coalesce(observed, 0.0), 6) AS observed FROM (SELECT DISTINCT read, unnest(range(0, 101))::INT AS bin FROM gcn) k LEFT JOIN gr USING (read, bin) LEFT JOIN gf USING (read, bin))"""
reads_query("gc_raw", MORE + _GCD + "SELECT read, bin, reads FROM gd")(lambda d: M.gc_distribution(d).select("read", "bin", "reads"))
reads_query("gc_fractional", MORE + _GCD + "SELECT read, bin, observed FROM gd")(lambda d: M.gc_distribution(d).select("read", "bin", "observed"))
_DEVIATION = _GCD + """,
d1 AS (SELECT *, sum(observed) OVER w AS total, max(observed) OVER w AS top FROM gd WINDOW w AS (PARTITION BY read)),
d2 AS (SELECT *, min(bin) FILTER (observed = top) OVER w AS mode, observed > 0.9::DOUBLE * top AS high FROM d1 WINDOW w AS (PARTITION BY read)),
d3 AS (SELECT *, min(bin) FILTER (bin > mode AND NOT high) OVER w AS r, max(bin) FILTER (bin < mode AND NOT high) OVER w AS l FROM d2 WINDOW w AS (PARTITION BY read)),
d4 AS (SELECT *, CASE WHEN l IS NULL OR r IS NULL THEN mode::DOUBLE ELSE (l + r) / 2.0::DOUBLE END AS centre FROM d3),
d5 AS (SELECT *, sum(observed * (bin - centre) ** 2) OVER (PARTITION BY read) / (total - 1) AS variance FROM d4),
dv AS (SELECT read, round(sum(abs(total / sqrt(2 * pi() * variance) * exp(-((bin - centre) ** 2) / (2 * variance)) - observed)) * 100 / max(total), 6) AS deviation_percent FROM d5 GROUP BY read)"""
reads_query("gc_theoretical_deviation", MORE + _DEVIATION + "SELECT read, round(deviation_percent, 4) AS deviation_percent FROM dv")(lambda d: M.gc_deviation(M.gc_distribution(d)).select("read", F.round("deviation_percent", 4).alias("deviation_percent")))

_HITS = """
ah AS (SELECT record_number, read, length(sequence) AS n, a.ord, a.adapter, instr(sequence, substr(a.seq, 1, 12))::INT AS hit FROM reads, adapters a WHERE a.adapter <> CASE read WHEN 'R1' THEN 'TruSeq_R2' ELSE 'TruSeq_R1' END AND instr(sequence, substr(a.seq, 1, 12)) > 0)"""
reads_query("adapter_first_hit", MORE + _HITS + "SELECT record_number, read, adapter, hit FROM ah")(lambda d: d.select("record_number", "read", F.explode(M.first_hits(F.col("read"), F.col("sequence"))).alias("x")).select("record_number", "read", "x.*"))
_CONTENT = _HITS + """,
tot AS (SELECT read, count(*) AS total, max(length(sequence)) AS longest FROM reads GROUP BY read),
ad AS (SELECT read, total, unnest(range(1, longest + 1))::INT AS position FROM tot),
ac AS (SELECT ad.read, a.adapter, ad.position, round(100.0::DOUBLE * coalesce(h.k, 0) / ad.total, 6) AS percent FROM ad JOIN adapters a ON a.adapter <> CASE ad.read WHEN 'R1' THEN 'TruSeq_R2' ELSE 'TruSeq_R1' END
  LEFT JOIN (SELECT read, adapter, p.position, count(*) AS k FROM ah, LATERAL (SELECT unnest(range(hit, n + 1)) AS position) p GROUP BY ALL) h ON h.read = ad.read AND h.adapter = a.adapter AND h.position = ad.position)"""
reads_query("adapter_content", MORE + _CONTENT + "SELECT * FROM ac")(M.adapter_content)
reads_query("reads_with_adapter", WITH + f"SELECT read, count(*) FILTER ({_HIT}) AS adapter_reads FROM reads GROUP BY read")(lambda d: d.groupBy("read").agg(F.sum((F.size(M.first_hits(F.col("read"), F.col("sequence"))) > 0).cast("long")).alias("adapter_reads")))

_DUP = """
dc AS (SELECT read, upper(substr(sequence, 1, 50)) AS key50, count(*) AS n FROM reads WHERE length(sequence) > 0 GROUP BY ALL)"""
reads_query("duplication_counts", MORE + _DUP + "SELECT * FROM dc")(M.duplication_counts)
_LABELS = "VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(E.DUPLICATION_LABELS))
_LEVELS = _DUP + f""",
dl(level_index, duplication_level) AS ({_LABELS}),
db AS (SELECT read, n, CASE WHEN n < 10 THEN n - 1 WHEN n <= 50 THEN 9 WHEN n <= 100 THEN 10 WHEN n <= 500 THEN 11 WHEN n <= 1000 THEN 12 WHEN n <= 5000 THEN 13 WHEN n <= 10000 THEN 14 ELSE 15 END AS i FROM dc),
ds AS (SELECT read, i, sum(n) AS reads, count(*) AS keys FROM db GROUP BY ALL), dt AS (SELECT read, sum(n) AS reads, count(*) AS keys FROM db GROUP BY read)"""
reads_query("duplication_levels", MORE + _LEVELS + """
SELECT dt.read, level_index::INT AS level_index, duplication_level, round(coalesce(100.0::DOUBLE * ds.reads / dt.reads, 0.0), 6) AS total_percent, round(coalesce(100.0::DOUBLE * ds.keys / dt.keys, 0.0), 6) AS deduplicated_percent
FROM dt, dl LEFT JOIN ds ON ds.read = dt.read AND ds.i = dl.level_index""".replace("FROM dt, dl LEFT JOIN", "FROM dt CROSS JOIN dl LEFT JOIN"))(lambda d: M.duplication_levels(M.duplication_counts(d)))
reads_query("duplication_summary", MORE + _DUP + "SELECT read, sum(n)::BIGINT AS total_reads, count(*) AS unique_sequences, round(100.0::DOUBLE * count(*) / sum(n), 6) AS deduplicated_remaining_percent FROM dc GROUP BY read")(lambda d: M.duplication_summary(M.duplication_counts(d)))
reads_query("overrepresented", MORE + _DUP + "SELECT read, key50 AS sequence, n AS reads, round(100.0::DOUBLE * n / total, 6) AS percent FROM (SELECT *, sum(n) OVER (PARTITION BY read) AS total FROM dc) WHERE 100.0::DOUBLE * n / total >= 0.1::DOUBLE")(lambda d: M.overrepresented(M.duplication_counts(d)))

# trimming steps
_OUT = ("record_number", "sequence", "quality")


def _step(*more: str, **own):
    """A trimming with the options ``own`` alone."""
    return lambda d: T.trim_reads(d, T.TrimConfig(**own)).select(*_OUT, *more)


reads_query("umi_extract", WITH + "SELECT record_number, CASE WHEN length(sequence) >= 8 THEN concat(header, ' UMI:', substr(sequence, 1, 8)) ELSE header END AS header, CASE WHEN length(sequence) >= 8 THEN substr(sequence, 9) ELSE sequence END AS sequence, CASE WHEN length(sequence) >= 8 THEN substr(quality, 9) ELSE quality END AS quality, CASE WHEN length(sequence) < 8 THEN 'UMI_TOO_SHORT' END AS failed FROM reads")(
    _step("header", "failed", umi_length=8)
)
reads_query("trim_fixed", WITH + "SELECT record_number, substr(sequence, 4, greatest(0, length(sequence) - 5)) AS sequence, substr(quality, 4, greatest(0, length(sequence) - 5)) AS quality FROM reads")(_step(front=3, tail=2))
_CF = "length(regexp_replace(quality, '^[\\x21-\\x34]+', ''))"
_CT = "length(regexp_replace(quality, '[\\x21-\\x34]+$', ''))"
reads_query("cut_front", WITH + f"SELECT record_number, substr(sequence, length(sequence) - {_CF} + 1) AS sequence, substr(quality, length(sequence) - {_CF} + 1) AS quality, {_CF} < length(sequence) AS quality_trimmed FROM reads")(_step("quality_trimmed", cut_front=True))
reads_query("cut_tail", WITH + f"SELECT record_number, substr(sequence, 1, {_CT}) AS sequence, substr(quality, 1, {_CT}) AS quality, {_CT} < length(sequence) AS quality_trimmed FROM reads")(_step("quality_trimmed", cut_tail=True))
_CR = "coalesce(list_min(list_filter(range(0, length(quality) - 3), lambda i: ascii(quality[i + 1]) + ascii(quality[i + 2]) + ascii(quality[i + 3]) + ascii(quality[i + 4]) - 132 < 80)), length(sequence))"
reads_query("cut_right", WITH + f"SELECT record_number, substr(sequence, 1, c) AS sequence, substr(quality, 1, c) AS quality, c < length(sequence) AS quality_trimmed FROM (SELECT *, {_CR} AS c FROM reads)")(_step("quality_trimmed", cut_right=True))


def _adapter_cte(source: str, target: str, key: str = "record_number", sequence: str = "sequence") -> str:
    """First approximate hit by trying every adapter at every position."""
    return f"""{target} AS (SELECT {key}, min(p) AS cut FROM (
      SELECT s.{key}, p, length(a.seq) AS la, least(length(a.seq), length(s.{sequence}) - p) AS k, substr(upper(s.{sequence}), p::BIGINT + 1, least(length(a.seq), length(s.{sequence}) - p)::BIGINT) AS x, substr(a.seq, 1, least(length(a.seq), length(s.{sequence}) - p)::BIGINT) AS y
      FROM (SELECT *, unnest(range(0, greatest(0, length({sequence}) - 5))) AS p FROM {source}) s, adapters a) z WHERE hamming(x, y) <= k // 8 GROUP BY {key})"""


reads_query("adapter_trim", MORE + _adapter_cte("reads", "f") + " SELECT record_number, substr(sequence, 1, coalesce(cut, length(sequence))) AS sequence, substr(quality, 1, coalesce(cut, length(sequence))) AS quality, cut::INT AS adapter_position FROM reads LEFT JOIN f USING (record_number)")(
    _step("adapter_position", adapter_trimming=True)
)
_PG = "length(sequence) - length(regexp_replace(sequence, '[Gg]+$', ''))"
_PX = "length(regexp_extract(upper(sequence), '(A+|C+|G+|T+)$', 1))"
for _name, _tail, _flag, _f in (("polyg_trim", _PG, "poly_g_trimmed", "poly_g"), ("polyx_trim", _PX, "poly_x_trimmed", "poly_x")):
    reads_query(_name, WITH + f"SELECT record_number, substr(sequence, 1, length(sequence) - c) AS sequence, substr(quality, 1, length(sequence) - c) AS quality, c > 0 AS {_flag} FROM (SELECT *, CASE WHEN {_tail} >= 6 THEN {_tail} ELSE 0 END AS c FROM reads)")(_step(_flag, **{_f: 6}))
reads_query("min_length_filter", WITH + "SELECT record_number, sequence, quality FROM reads WHERE length(sequence) >= 40")(lambda d: T.trim_reads(d, T.TrimConfig(min_length=40)).where("passed").select(*_OUT))

SE = T.TrimConfig(umi_length=4, front=2, tail=1, cut_front=True, cut_tail=True, cut_right=True, quality=15, window=4, adapter_trimming=True, poly_g=8, poly_x=8, min_length=20)
_B = "[\\x21-\\x2f]+"
_CR15 = "coalesce(list_min(list_filter(range(0, length(quality) - 3), lambda i: ascii(quality[i + 1]) + ascii(quality[i + 2]) + ascii(quality[i + 3]) + ascii(quality[i + 4]) - 132 < 60)), length(sequence))"
_SE = (
    """
s0 AS (SELECT record_number, read, sequence AS s, quality AS q, length(sequence) AS original_length FROM reads),
s1 AS (SELECT *, substr(s, 5) AS sequence, substr(q, 5) AS quality FROM s0),
s2 AS (SELECT * REPLACE (substr(sequence, 3, greatest(0, length(sequence) - 3)) AS sequence, substr(quality, 3, greatest(0, length(quality) - 3)) AS quality) FROM s1),
s3 AS (SELECT *, length(sequence) AS n2, length(regexp_replace(quality, '^%s', '')) AS c3 FROM s2),
s4 AS (SELECT * REPLACE (substr(sequence, n2 - c3 + 1) AS sequence, substr(quality, n2 - c3 + 1) AS quality) FROM s3),
s5 AS (SELECT *, length(regexp_replace(quality, '%s$', '')) AS c5 FROM s4),
s6 AS (SELECT * REPLACE (substr(sequence, 1, c5) AS sequence, substr(quality, 1, c5) AS quality) FROM s5),
s7 AS (SELECT *, %s AS c7 FROM s6),
s8 AS (SELECT * REPLACE (substr(sequence, 1, c7) AS sequence, substr(quality, 1, c7) AS quality) FROM s7),
"""
    % (_B, _B, _CR15)
    + _adapter_cte("s8", "s9")
    + """,
s10 AS (SELECT s8.* REPLACE (substr(sequence, 1, coalesce(cut, length(sequence))) AS sequence, substr(quality, 1, coalesce(cut, length(sequence))) AS quality), cut, c7 < n2 AS quality_trimmed FROM s8 LEFT JOIN s9 USING (record_number)),
s11 AS (SELECT *, CASE WHEN length(sequence) - length(regexp_replace(sequence, '[Gg]+$', '')) >= 8 THEN length(regexp_replace(sequence, '[Gg]+$', '')) ELSE length(sequence) END AS cg FROM s10),
s12 AS (SELECT *, cg < length(sequence) AS poly_g, substr(sequence, 1, cg) AS sg, substr(quality, 1, cg) AS qg FROM s11),
s13 AS (SELECT *, CASE WHEN length(regexp_extract(upper(sg), '(A+|C+|G+|T+)$', 1)) >= 8 THEN length(sg) - length(regexp_extract(upper(sg), '(A+|C+|G+|T+)$', 1)) ELSE length(sg) END AS cx FROM s12),
st AS (SELECT record_number, read, original_length, substr(sg, 1, cx) AS sequence, substr(qg, 1, cx) AS quality, quality_trimmed, cut::INT AS adapter_position, poly_g AS poly_g_trimmed, cx < length(sg) AS poly_x_trimmed, cx >= 20 AS passed FROM s13)
"""
)
reads_query("trim_pipeline_se", MORE + _SE + "SELECT record_number, sequence, quality, quality_trimmed, adapter_position, poly_g_trimmed, poly_x_trimmed, passed FROM st")(
    lambda d: T.trim_reads(d, SE).select(*_OUT, "quality_trimmed", "adapter_position", "poly_g_trimmed", "poly_x_trimmed", "passed")
)
_b = lambda x: f"count(*) FILTER ({x})"
reads_query("trim_stats_se", MORE + _SE + f"""
SELECT read, count(*) AS total_reads, {_b('passed')} AS passed_reads, {_b('NOT passed')} AS discarded_reads, sum(original_length)::BIGINT AS bases_before, sum(length(sequence))::BIGINT AS bases_after, sum(original_length - length(sequence))::BIGINT AS bases_trimmed,
  {_b('quality_trimmed')} AS quality_trimmed_reads, count(adapter_position) AS adapter_trimmed_reads, {_b('poly_g_trimmed')} AS poly_g_trimmed_reads, {_b('poly_x_trimmed')} AS poly_x_trimmed_reads, {_b('NOT passed')} AS too_short_reads,
  0::BIGINT AS corrected_reads, 0::BIGINT AS corrected_bases, count(*) AS umi_processed_reads, 0::BIGINT AS umi_failed_reads, (4 * count(*))::BIGINT AS umi_bases FROM st GROUP BY read""")(lambda d: T.trim_statistics(T.trim_reads(d, SE), ("read",)))
reads_query("adapter_positions", MORE + _SE + "SELECT adapter_position AS position, count(*) AS reads FROM st WHERE adapter_position IS NOT NULL GROUP BY 1")(lambda d: T.adapter_positions(T.trim_reads(d, SE)))
reads_query("after_qc_reads", MORE + _SE + "SELECT read, count(*) AS reads, sum(length(sequence))::BIGINT AS bases FROM st WHERE passed AND length(sequence) > 0 GROUP BY read")(
    lambda d: M.basic_statistics(T.trim_reads(d, SE).where("passed")).select("read", "reads", "bases")
)
reads_query("qc_before_after", MORE + _SE + """,
ba AS (SELECT read, length(sequence) AS length, count(*) AS b FROM reads GROUP BY ALL), af AS (SELECT read, length(sequence) AS length, count(*) AS a FROM st WHERE passed AND length(sequence) > 0 GROUP BY ALL)
SELECT read, length::INT AS length, coalesce(b, 0) AS before, coalesce(a, 0) AS after, (coalesce(a, 0) - coalesce(b, 0))::BIGINT AS delta FROM ba FULL JOIN af USING (read, length)""")(
    lambda d: M.length_distribution(d).withColumnRenamed("reads", "before").join(M.length_distribution(T.trim_reads(d, SE).where("passed")).withColumnRenamed("reads", "after"), ["read", "length"], "full_outer")
    .select("read", "length", F.coalesce("before", F.lit(0).cast("long")).alias("before"), F.coalesce("after", F.lit(0).cast("long")).alias("after")).withColumn("delta", F.col("after") - F.col("before"))
)
reads_query("reverse_complement", WITH + "SELECT record_number, reverse(translate(regexp_replace(upper(sequence), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS rc, reverse(quality) AS rq FROM reads")(lambda d: d.select("record_number", E.reverse_complement(F.col("sequence")).alias("rc"), F.reverse("quality").alias("rq")))


# pairs
_RC2 = "reverse(translate(regexp_replace(upper({s}), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"
CONFIG = T.TrimConfig(correction=True, merge=True, min_overlap=20)


def _overlap_cte(source: str, target: str, s1: str = "sequence1", s2: str = "sequence2") -> str:
    """Best overlap by trying all shifts: length, mismatches and starts in the order of preference."""
    return f"""{target} AS (SELECT record_number, min(struct_pack(n := -n, m := m, s1 := s1, s2 := s2)) AS o FROM (
      SELECT record_number, s1, s2, n, hamming(substr(a, s1::BIGINT + 1, n::BIGINT), substr(b, s2::BIGINT + 1, n::BIGINT)) AS m FROM (
        SELECT record_number, a, b, greatest(sh, 0) AS s1, greatest(-sh, 0) AS s2, least(length(a) - greatest(sh, 0), length(b) - greatest(-sh, 0)) AS n FROM (
          SELECT record_number, regexp_replace(upper({s1}), '[^ACGT]', 'N', 'g') AS a, {_RC2.format(s=s2)} AS b, unnest(range(20 - length({s2}), length({s1}) - 19)) AS sh FROM {source}) x) y
      WHERE n >= 20) z WHERE m <= least(5, 20 * n // 100) GROUP BY record_number)"""


_PAIR_OUT = ("record_number", "sequence1", "quality1", "sequence2", "quality2")
pairs_query("pair_id_mismatch", WITH + r"""SELECT * FROM (SELECT record_number, regexp_replace(split_part(regexp_replace(header1, '^@', ''), ' ', 1), '/[12]$', '') AS id1, regexp_replace(split_part(regexp_replace(header2, '^@', ''), ' ', 1), '/[12]$', '') AS id2 FROM pairs) WHERE id1 <> id2""")(V.id_mismatches)
_side = lambda d, k: d.select("record_number", F.col(f"header{k}").alias("header"), F.col(f"sequence{k}").alias("sequence"), F.col(f"quality{k}").alias("quality"))
pairs_query("pair_join", WITH + "SELECT record_number, header1, sequence1, quality1, header2, sequence2, quality2 FROM pairs")(lambda d: P.join_mates(_side(d, 1), _side(d, 2)))
pairs_query("mate_problems", WITH + "SELECT record_number, CASE WHEN record_number % 97 = 0 THEN 'r2_missing' ELSE 'id_mismatch' END AS rule FROM pairs WHERE record_number % 97 = 0 OR substr(header2, 2, 1) = 'x'")(
    lambda d: V.mate_problems(_side(d, 1), _side(d, 2).where("record_number % 97 <> 0"))
)
pairs_query("overlap_find", MORE + _overlap_cte("pairs", "ov") + "SELECT record_number, (o.s1)::INT AS start1, (o.s2)::INT AS start2, (-o.n)::INT AS length, (o.m)::INT AS mismatches FROM ov")(
    lambda d: P.with_overlap(d, CONFIG).where("overlap IS NOT NULL").select("record_number", "overlap.*")
)
_CHAR = """
pc AS (SELECT p.record_number, header1, sequence1, quality1, sequence2, quality2, o.s1 AS s1, o.s2 AS s2, -o.n AS n, regexp_replace(upper(sequence1), '[^ACGT]', 'N', 'g') AS a, reverse(translate(regexp_replace(upper(sequence2), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS b, reverse(quality2) AS rq,
  reverse(translate(sequence2, 'ACGTacgt', 'TGCATGCA')) AS raw FROM pairs p LEFT JOIN ov USING (record_number))"""
_CORRECT = """,
k AS (SELECT *, list_transform(range(0, length(sequence1)), lambda i: s1 IS NOT NULL AND i >= s1 AND i < s1 + n AND a[i + 1] <> b[i - s1 + s2 + 1] AND b[i - s1 + s2 + 1] <> 'N' AND ascii(rq[i - s1 + s2 + 1]) > ascii(quality1[i + 1])) AS f1,
  list_transform(range(0, length(sequence2)), lambda j: s1 IS NOT NULL AND j >= s2 AND j < s2 + n AND a[j - s2 + s1 + 1] <> b[j + 1] AND a[j - s2 + s1 + 1] <> 'N' AND ascii(quality1[j - s2 + s1 + 1]) > ascii(rq[j + 1])) AS f2 FROM pc),
co AS (SELECT record_number, array_to_string(list_transform(range(0, length(sequence1)), lambda i: CASE WHEN f1[i + 1] THEN b[i - s1 + s2 + 1] ELSE sequence1[i + 1] END), '') AS sequence1, array_to_string(list_transform(range(0, length(sequence1)), lambda i: CASE WHEN f1[i + 1] THEN rq[i - s1 + s2 + 1] ELSE quality1[i + 1] END), '') AS quality1,
  reverse(array_to_string(list_transform(range(0, length(sequence2)), lambda j: CASE WHEN f2[j + 1] THEN translate(a[j - s2 + s1 + 1], 'ACGT', 'TGCA') ELSE reverse(sequence2)[j + 1] END), '')) AS sequence2, reverse(array_to_string(list_transform(range(0, length(sequence2)), lambda j: CASE WHEN f2[j + 1] THEN quality1[j - s2 + s1 + 1] ELSE rq[j + 1] END), '')) AS quality2,
  len(list_filter(f1, lambda x: x))::BIGINT AS corrected1, len(list_filter(f2, lambda x: x))::BIGINT AS corrected2 FROM k)
SELECT * FROM co"""
pairs_query("overlap_correct", MORE + _overlap_cte("pairs", "ov") + "," + _CHAR + _CORRECT)(lambda d: P.correct_overlaps(P.with_overlap(d, CONFIG)).select(*_PAIR_OUT, "corrected1", "corrected2"))
_MERGE = """,
mg AS (SELECT *, s1 - s2 AS sh, CASE WHEN s1 = 0 AND s2 > 0 THEN 0 ELSE least(0, s1 - s2) END AS lo, CASE WHEN s1 = 0 AND s2 > 0 THEN n ELSE greatest(length(sequence1), s1 - s2 + length(b)) END AS hi FROM pc WHERE s1 IS NOT NULL),
me AS (SELECT *, list_transform(range(lo, hi), lambda i: CASE WHEN i >= 0 AND i < length(a) AND i - sh >= 0 AND i - sh < length(b) THEN
    CASE WHEN a[i + 1] = b[i - sh + 1] OR ascii(quality1[i + 1]) > ascii(rq[i - sh + 1]) THEN a[i + 1] WHEN ascii(rq[i - sh + 1]) > ascii(quality1[i + 1]) THEN b[i - sh + 1] ELSE 'N' END
    WHEN i >= 0 AND i < length(a) THEN sequence1[i + 1] ELSE b[i - sh + 1] END) AS ms,
  list_transform(range(lo, hi), lambda i: CASE WHEN i >= 0 AND i < length(a) AND i - sh >= 0 AND i - sh < length(b) THEN chr(greatest(ascii(quality1[i + 1]), ascii(rq[i - sh + 1]))) WHEN i >= 0 AND i < length(a) THEN quality1[i + 1] ELSE rq[i - sh + 1] END) AS mq FROM mg)
SELECT record_number, concat('@', regexp_replace(substr(header1, 2), '/[12]$', ''), ' merged') AS header, array_to_string(ms, '') AS sequence, '+' AS separator, array_to_string(mq, '') AS quality FROM me"""
pairs_query("pair_merge", MORE + _overlap_cte("pairs", "ov") + "," + _CHAR + _MERGE)(lambda d: P.merge_overlaps(P.with_overlap(d, CONFIG)))
READ_THROUGH = T.TrimConfig(merge=True, min_overlap=20, adapter_trimming=True, adapters=("NNNNNNNN",))
pairs_query("read_through_trim", MORE + _overlap_cte("pairs", "ov") + """
SELECT record_number, substr(sequence1, 1, -o.n) AS sequence1, substr(quality1, 1, -o.n) AS quality1, substr(sequence2, 1, -o.n) AS sequence2, substr(quality2, 1, -o.n) AS quality2 FROM pairs JOIN ov USING (record_number) WHERE o.s1 = 0 AND o.s2 > 0""")(
    lambda d: P.trim_pairs(d, READ_THROUGH).where("overlap.start1 = 0 AND overlap.start2 > 0").select(*_PAIR_OUT)
)
PE = T.TrimConfig(cut_tail=True, quality=15, adapter_trimming=True, poly_g=8, min_length=30, min_overlap=20, correction=True, merge=True)
#: Trimmed by adapters and length only, so that the SQL stays readable.
PE_PLAIN = T.TrimConfig(cut_tail=True, quality=15, adapter_trimming=True, min_length=30)
_PE = ("""
t1 AS (SELECT record_number, length(sequence1) AS n1, length(sequence2) AS n2, substr(sequence1, 1, length(regexp_replace(quality1, '%s$', ''))) AS sequence1, regexp_replace(quality1, '%s$', '') AS quality1, substr(sequence2, 1, length(regexp_replace(quality2, '%s$', ''))) AS sequence2, regexp_replace(quality2, '%s$', '') AS quality2 FROM pairs),
""" % ((_B,) * 4) + _adapter_cte("t1", "f1", sequence="sequence1") + "," + _adapter_cte("t1", "f2", sequence="sequence2") + """,
t2 AS (SELECT record_number, n1, n2, length(sequence1) < n1 AS c1, length(sequence2) < n2 AS c2, f1.cut AS p1, f2.cut AS p2, substr(sequence1, 1, coalesce(f1.cut, 50)) AS sequence1, substr(quality1, 1, coalesce(f1.cut, 50)) AS quality1, substr(sequence2, 1, coalesce(f2.cut, 50)) AS sequence2, substr(quality2, 1, coalesce(f2.cut, 50)) AS quality2
  FROM t1 LEFT JOIN f1 USING (record_number) LEFT JOIN f2 USING (record_number)),
t3 AS (SELECT *, length(sequence1) >= 30 AS passed1, length(sequence2) >= 30 AS passed2, passed1 AND passed2 AS passed FROM t2)""")
pairs_query("trim_pipeline_pe", MORE + _PE + "SELECT record_number, sequence1, quality1, sequence2, quality2, passed1, passed2, passed FROM t3")(lambda d: P.trim_pairs(d, PE_PLAIN).select(*_PAIR_OUT, "passed1", "passed2", "passed"))
pairs_query("pair_filter_any", MORE + _PE + "SELECT record_number, sequence1, quality1, sequence2, quality2 FROM t3 WHERE passed")(lambda d: P.trim_pairs(d, PE_PLAIN).where("passed").select(*_PAIR_OUT))
pairs_query("trim_stats_pe", MORE + _PE + f"""
SELECT (2 * count(*))::BIGINT AS total_reads, ({_b('passed1')} + {_b('passed2')})::BIGINT AS passed_reads, ({_b('NOT passed1')} + {_b('NOT passed2')})::BIGINT AS discarded_reads, sum(n1 + n2)::BIGINT AS bases_before, sum(length(sequence1) + length(sequence2))::BIGINT AS bases_after, sum(n1 + n2 - length(sequence1) - length(sequence2))::BIGINT AS bases_trimmed,
  ({_b('c1')} + {_b('c2')})::BIGINT AS quality_trimmed_reads, (count(p1) + count(p2))::BIGINT AS adapter_trimmed_reads, 0::BIGINT AS poly_g_trimmed_reads, 0::BIGINT AS poly_x_trimmed_reads, ({_b('NOT passed1')} + {_b('NOT passed2')})::BIGINT AS too_short_reads,
  0::BIGINT AS corrected_reads, 0::BIGINT AS corrected_bases, 0::BIGINT AS umi_processed_reads, 0::BIGINT AS umi_failed_reads, 0::BIGINT AS umi_bases, count(*) AS total_pairs, {_b('passed')} AS passed_pairs, {_b('NOT passed')} AS discarded_pairs, (2 * {_b('passed')})::BIGINT AS output_reads,
  ({_b('passed1 AND NOT passed')} + {_b('passed2 AND NOT passed')})::BIGINT AS mate_discarded_reads, 0::BIGINT AS merged_pairs FROM t3""")(lambda d: P.pair_statistics(P.trim_pairs(d, PE_PLAIN)))
#: All steps at once; no SQL form. Tests hold it against the single steps and the published examples.
pairs_query("trim_pipeline_pe_full", None)(lambda d: P.trim_pairs(d, PE).select(*_PAIR_OUT, "passed1", "passed2", "passed", F.col("merged.sequence").alias("merged_sequence")))

# checks, rules, cases


def _faulty(d: DataFrame) -> DataFrame:
    n = F.col("record_number")
    return d.withColumns({
        "header": F.when(n % 107 == 0, F.substr(F.col("header"), F.lit(2))).otherwise(F.col("header")), "separator": F.when(n % 109 == 0, "x").otherwise("+"),
        "quality": F.when(n % 101 == 0, F.concat("quality", F.lit("I"))).when(n % 103 == 0, F.concat(F.lit(" "), F.substr(F.col("quality"), F.lit(2)))).otherwise(F.col("quality")),
        "sequence": F.when(n % 113 == 0, F.concat(F.lit("x"), F.substr(F.col("sequence"), F.lit(2)))).otherwise(F.col("sequence")),
    })


reads_query("validation_errors", WITH + """
SELECT read, record_number, CASE WHEN record_number % 107 = 0 THEN 'header' WHEN record_number % 109 = 0 THEN 'separator' WHEN record_number % 101 = 0 THEN 'length' WHEN record_number % 103 = 0 THEN 'quality_range' ELSE 'alphabet' END AS rule
FROM reads WHERE record_number % 107 = 0 OR record_number % 109 = 0 OR record_number % 101 = 0 OR record_number % 103 = 0 OR record_number % 113 = 0""")(lambda d: V.read_faults(_faulty(d)).select("read", "record_number", "rule"))
_RULES = "VALUES " + ", ".join(f"({i}, '{m}', '{o}', " + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in rest[1:]) + ")" for i, (m, o, *rest) in enumerate(R.STANDARD))
_OBSERVED = (_POSITION + _WIDTHS + "," + _BASES.replace("c AS (", "bc AS (").replace("FROM b GROUP", "FROM b GROUP") + "," + _READ_QUALITY + "," + _DEVIATION + "," + _CONTENT + "," + _DUP + f""",
rl(ord, metric_id, observation, warn_op, warn_value, fail_op, fail_value) AS ({_RULES}),
gq AS (SELECT read, first, avg(lower_quartile) AS lq, avg(median) AS md FROM g GROUP BY ALL),
ob AS (
  SELECT read, 'minimum_lower_quartile' AS observation, round(min(lq), 4) AS value FROM gq GROUP BY read UNION ALL SELECT read, 'minimum_median', round(min(md), 4) FROM gq GROUP BY read
  UNION ALL SELECT read, 'modal_mean_quality', arg_max(mean_quality, read_count_truncate * 1000 - mean_quality) FROM rq GROUP BY read
  UNION ALL SELECT read, 'maximum_base_difference_percent', max(greatest(abs(round(100.0::DOUBLE * n_a / (n_a + n_c + n_g + n_t), 6) - round(100.0::DOUBLE * n_t / (n_a + n_c + n_g + n_t), 6)), abs(round(100.0::DOUBLE * n_g / (n_a + n_c + n_g + n_t), 6) - round(100.0::DOUBLE * n_c / (n_a + n_c + n_g + n_t), 6)))) FROM bc WHERE n_a + n_c + n_g + n_t > 0 GROUP BY read
  UNION ALL SELECT read, 'maximum_n_percent', max(round(100.0::DOUBLE * n_n / coverage, 6)) FROM bc GROUP BY read
  UNION ALL SELECT read, 'modeled_deviation_percent', deviation_percent FROM dv
  UNION ALL SELECT read, 'observed_length_count', count(DISTINCT length(sequence))::DOUBLE FROM reads GROUP BY read UNION ALL SELECT read, 'minimum_length', min(length(sequence))::DOUBLE FROM reads GROUP BY read
  UNION ALL SELECT read, 'deduplicated_loss_percent', 100 - round(100.0::DOUBLE * count(*) / sum(n), 6) FROM dc GROUP BY read
  UNION ALL SELECT read, 'maximum_adapter_percent', max(percent) FROM ac GROUP BY read),
ev AS (SELECT k.read, rl.ord, rl.metric_id, rl.observation, round(ob.value, 4) AS value, CASE WHEN ob.value IS NULL THEN 'not_evaluated'
    WHEN (fail_op = '<' AND value < fail_value) OR (fail_op = '>' AND value > fail_value) OR (fail_op = '<=' AND value <= fail_value) THEN 'fail'
    WHEN (warn_op = '<' AND value < warn_value) OR (warn_op = '>' AND value > warn_value) THEN 'warning' ELSE 'pass' END AS status
  FROM (SELECT DISTINCT read FROM reads) k CROSS JOIN rl LEFT JOIN ob ON ob.read = k.read AND ob.observation = rl.observation),
ms AS (SELECT read, metric_id, CASE WHEN bool_or(status = 'not_evaluated') THEN 'not_evaluated' WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'pass' END AS status FROM ev GROUP BY ALL)""")


def _evaluated(d: DataFrame) -> DataFrame:
    return R.evaluate(R.observations(d), R.rule_table(d.sparkSession))


reads_query("rule_evaluation", MORE + _OBSERVED + "SELECT read, ord::INT AS ord, metric_id, observation, value, status FROM ev")(lambda d: _evaluated(d).withColumn("value", F.round("value", 4)))
reads_query("status_summary", MORE + _OBSERVED + """SELECT count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'warning') AS n_warning, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'not_evaluated') AS n_not_evaluated,
  CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warning') THEN 'warning' WHEN bool_or(status = 'pass') THEN 'pass' ELSE 'not_evaluated' END AS overall FROM ms""")(lambda d: R.status_summary(R.metric_status(_evaluated(d))))
reads_query("module_status", MORE + _OBSERVED + "SELECT metric_id, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warning') THEN 'warning' WHEN bool_or(status = 'pass') THEN 'pass' ELSE 'not_evaluated' END AS status FROM ms GROUP BY metric_id")(lambda d: R.module_status(R.metric_status(_evaluated(d))))
sheet_query("sample_sheet_errors", MORE + """
fs AS (SELECT line, unnest([r1, r2]) AS file, unnest([0, 1]) AS side FROM sheet), ft AS (SELECT DISTINCT line FROM (SELECT line, row_number() OVER (PARTITION BY file ORDER BY line, side) AS n FROM fs WHERE file <> '') WHERE n > 1),
se AS (SELECT s.line, patient_id, sample_id, CASE WHEN sample_role NOT IN ('tumor', 'normal', 'tumor_rna') THEN 'sample_role must be tumor, normal, or tumor_rna' WHEN material NOT IN ('dna', 'rna') THEN 'material must be dna or rna'
  WHEN sample_role = 'tumor_rna' AND material <> 'rna' THEN 'tumor_rna must have material rna' WHEN sample_role IN ('tumor', 'normal') AND material <> 'dna' THEN 'DNA samples must have material dna'
  WHEN row_number() OVER (PARTITION BY patient_id, sample_id ORDER BY s.line) > 1 THEN 'sample_id is repeated for the patient' WHEN ft.line IS NOT NULL THEN 'a file is used twice' END AS fault FROM sheet s LEFT JOIN ft ON ft.line = s.line)
SELECT * FROM se WHERE fault IS NOT NULL""")(V.sheet_faults)
sheet_query("case_roles", MORE + """
cr AS (SELECT patient_id, bool_or(sample_role = 'tumor') AS tumor, bool_or(sample_role = 'normal') AS normal, bool_or(sample_role = 'tumor_rna') AS tumor_rna, arg_max(reference, line) FILTER (sample_role = 'tumor') AS a, arg_max(reference, line) FILTER (sample_role = 'normal') AS b FROM sheet GROUP BY patient_id)
SELECT patient_id, tumor, normal, tumor_rna, NOT (tumor AND normal AND a <> b) AS same_reference, CASE WHEN (tumor AND NOT normal) OR (tumor AND normal AND a <> b) THEN 'error' WHEN NOT tumor_rna THEN 'warning' ELSE 'ok' END AS status FROM cr""".replace("NOT (tumor AND normal AND a <> b) AS same_reference", "coalesce(NOT (tumor AND normal AND a <> b), true) AS same_reference"))(V.case_roles)


def _fastq_round_trip(d: DataFrame) -> DataFrame:
    """Reads written as gzip FASTQ and scanned again, through a folder that all executors share if one is set."""
    shared = d.sparkSession.conf.get("spark.checkpoint.dir", None)
    folder = tempfile.mkdtemp(prefix="fastq-", dir=shared.removeprefix("file://") if shared and shared.startswith(("/", "file:///")) else None)
    fastq.write_fastq(d.where(F.length("sequence") > 0), f"{folder}/reads", 4)
    return fastq.read_fastq(d.sparkSession, f"{folder}/reads").select("header", "sequence", "separator", "quality")


reads_query("fastq_roundtrip", WITH + "SELECT header, sequence, separator, quality FROM reads WHERE length(sequence) > 0")(_fastq_round_trip)
