"""Loudness and colour tracks, and interval joins against them.

Levels are integer thousandths of a decibel and times integer milliseconds, so
sums do not depend on the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtable.functions.text import let
from voxtable.operators.gates import select_with_gap
from voxtable.operators.ordered import HotKeys
from voxtable.session import cut_lineage

VIDEO = ["video_id"]
HOP_MS = 200
BLOCK_MS = 60_000


def loudness_hops(chunks: DataFrame) -> DataFrame:
    """Partial sums (video_id, hop_id, sum_sq, n, hop_size, n_hops) to (video_id, hop_id, t_ms, mdb).

    A partial last hop is dropped; a clip without a whole hop gives one hop at -60 dB.
    """
    sums = chunks.groupBy("video_id", "hop_id").agg(
        F.sum("sum_sq").alias("sum_sq"), F.sum("n").alias("n"), F.max("hop_size").alias("hop_size")
    )
    rms = F.sqrt(F.col("sum_sq") / F.col("n") + 1e-12)
    full = sums.filter(F.col("n") == F.col("hop_size")).select(
        "video_id",
        "hop_id",
        (F.col("hop_id") * HOP_MS).alias("t_ms"),
        F.round(20000 * F.log10(rms + 1e-9)).cast("bigint").alias("mdb"),
    )
    short = (
        sums.groupBy("video_id")
        .agg(F.max((F.col("n") == F.col("hop_size")).cast("int")).alias("any"))
        .filter("any = 0")
        .select("video_id", F.lit(0).cast("bigint").alias("hop_id"), F.lit(0).cast("bigint").alias("t_ms"), F.lit(-60000).cast("bigint").alias("mdb"))
    )
    return full.unionByName(short)


def half_up(total: Column, n: Column) -> Column:
    """Integer mean, rounded half up."""
    return F.floor((2 * total + n) / (2 * n))


def span_means(
    spans: DataFrame, track: DataFrame, span_id: str, values: list[str], *, closed: bool = False, block_ms: int = BLOCK_MS
) -> DataFrame:
    """Mean of track values over each span, or the value nearest to its start when none lies inside.

    Track rows and the two edges of every span stand in one order of time, cut into
    blocks. Running sums within a block and one carried row per block give the total
    up to each edge; a span's sum is the difference of two totals. The nearest values
    are the last one in front of and the first one behind the later edge. The track is
    read once, and no row meets the rows of a span.
    """
    last_ms = F.col("end_ms") if closed else F.greatest(F.col("end_ms"), F.col("start_ms") + 1) - 1
    s = spans.select("video_id", F.col(span_id).alias("_span"), "start_ms", last_ms.alias("_last"))
    edge = lambda at, phase: s.select("video_id", at.alias("t_ms"), F.lit(phase).alias("_phase"), "_span", "start_ms", "_last")
    edges = edge(F.col("start_ms"), 0).unionByName(edge(F.greatest("start_ms", "_last"), 2))
    rows = track.select("video_id", "t_ms", F.lit(1).alias("_phase"), "ord", *values).unionByName(edges, allowMissingColumns=True)
    rows = rows.withColumns({"_b": F.floor(F.col("t_ms") / block_ms), "_v": F.when(F.col("_phase") == 1, F.struct("t_ms", *values))})

    block = Window.partitionBy("video_id", "_b")
    onward, back = block.orderBy("t_ms", "_phase", F.desc("ord")), block.orderBy(F.desc("t_ms"), F.desc("_phase"), F.desc("ord"))
    upto = (Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "video_id", "_b", "_phase", "_span", "start_ms", "_last",
        F.count("_v").over(onward.rowsBetween(*upto)).alias("_n"),
        *[F.coalesce(F.sum(v).over(onward.rowsBetween(*upto)), F.lit(0)).alias(f"_sum_{v}") for v in values],
        F.last("_v", ignorenulls=True).over(onward.rowsBetween(*upto)).alias("_lo"),
        F.last("_v", ignorenulls=True).over(back.rowsBetween(*upto)).alias("_hi"),
        F.lead(F.lit(1)).over(onward).isNull().alias("_ends"), F.lag(F.lit(1)).over(onward).isNull().alias("_begins"),
    )
    kept = cut_lineage(rows.filter("_phase <> 1 OR _ends OR _begins"))  # two rows per span, two per block

    sums = ["_n", *[f"_sum_{v}" for v in values]]
    of = lambda flag, c: F.max(F.when(F.col(flag), F.col(c)))
    blocks = kept.groupBy("video_id", "_b").agg(*[of("_ends", c).alias(c) for c in sums], of("_ends", "_lo").alias("_lo"), of("_begins", "_hi").alias("_hi"))
    forth, later = Window.partitionBy("video_id").orderBy("_b"), Window.partitionBy("video_id").orderBy(F.desc("_b"))
    before = (Window.unboundedPreceding, -1)
    carry = blocks.select(
        "video_id", "_b", *[F.coalesce(F.sum(c).over(forth.rowsBetween(*before)), F.lit(0)).alias(f"_before{c}") for c in sums],
        F.last("_lo", ignorenulls=True).over(forth.rowsBetween(*before)).alias("_prev"), F.last("_hi", ignorenulls=True).over(later.rowsBetween(*before)).alias("_next"),
    )
    at = kept.filter("_phase <> 1").join(carry, ["video_id", "_b"])
    total = lambda c, phase: F.max(F.when(F.col("_phase") == phase, F.col(c) + F.col(f"_before{c}")))
    near = lambda own, carried: F.max(F.when(F.col("_phase") == 2, F.coalesce(own, carried)))
    whole = at.groupBy("video_id", "_span").agg(
        F.max("start_ms").alias("start_ms"), F.max("_last").alias("_last"), *[(total(c, 2) - total(c, 0)).alias(c) for c in sums],
        near("_lo", "_prev").alias("_lo"), near("_hi", "_next").alias("_hi"),
    )
    inside = (F.col("_n") > 0) & (F.col("_last") >= F.col("start_ms"))
    lo, hi = F.col("_lo"), F.col("_hi")
    first = lo.isNotNull() & (hi.isNull() | (F.col("start_ms") - lo["t_ms"] <= hi["t_ms"] - F.col("start_ms")))
    return whole.select(
        "video_id",
        F.col("_span").alias(span_id),
        *[F.when(inside, half_up(F.col(f"_sum_{v}"), F.col("_n"))).when(first, lo[v]).otherwise(hi[v]).alias(v) for v in values],
    )


def emphasis_threshold(levels: DataFrame) -> DataFrame:
    """(video_id, n, threshold): median plus max(1.2 dB, 0.40 of the interquartile range).

    Levels are first counted per distinct value, so the exact percentile of a hot
    video works on a histogram of thousandths of a decibel, not on its rows.
    """
    counts = levels.groupBy("video_id", "mdb").agg(F.count("*").alias("freq"))
    stats = counts.groupBy("video_id").agg(
        F.sum("freq").alias("n"), F.percentile("mdb", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("freq")).alias("q")
    )
    iqr = F.col("q")[2] - F.col("q")[0]
    spread = F.when(iqr == 0, 1000.0).otherwise(iqr)
    return stats.select("video_id", "n", (F.col("q")[1] + F.greatest(F.lit(1200.0), 0.4 * spread)).alias("threshold"))


def vocal_emphasis(levels: DataFrame, line_id: str, hot: HotKeys | None = None, gap_ms: int = 5000, share: float = 0.18) -> DataFrame:
    """Lines whose voice is louder than the speaker's own level: loudest first, spaced, budgeted.

    Levels are read for the threshold and for the rows above it, so they are stored once.
    """
    levels = cut_lineage(levels.select("video_id", line_id, "start_ms", "mdb"))
    eligible = levels.join(emphasis_threshold(levels), "video_id").filter(F.col("mdb") >= F.col("threshold"))
    budget = F.greatest(F.lit(1), F.bround(F.col("n") * share).cast("int"))
    return select_with_gap(
        eligible.withColumn("_budget", budget), VIDEO, line_id, "start_ms", gap_ms, first=[-F.col("mdb")], budget="_budget", hot=hot
    )


def color_track(pixels: DataFrame) -> DataFrame:
    """Per frame mean RGB and luma, in integer hundredths."""
    mean = pixels.groupBy("video_id", "frame").agg(*[half_up(100 * F.sum(c), F.count("*")).alias(c) for c in ("r", "g", "b")])
    luma = half_up(299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b"), F.lit(1000))
    return mean.withColumn("luma", luma)


def is_bright(luma: Column, default: bool = False) -> Column:
    return F.coalesce(luma > 15_000, F.lit(default))


def with_palette(colors: DataFrame, bright: Column) -> DataFrame:
    """Add outline, shade and glow tints ("r,g,b") of the background hue; null where a tint is not used."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    df = colors.withColumns({"_bright": bright, "_hi": F.greatest(r, g, b) / 255, "_lo": F.least(r, g, b) / 255})
    span, hi = F.col("_hi") - F.col("_lo"), F.col("_hi")
    hue = (
        F.when(span == 0, F.lit(0.0))
        .when(r / 255 == hi, F.pmod((g - b) / 255 / span, F.lit(6.0)))
        .when(g / 255 == hi, (b - r) / 255 / span + 2)
        .otherwise((r - g) / 255 / span + 4)
    ) / 6
    df = df.withColumns({"_hue": hue, "_sat": F.when(hi > 0, span / hi).otherwise(0.0)})
    neutral = r.isNull() | (F.col("_sat") < 0.08)
    df = df.withColumns({"_hue": F.when(neutral, 0.60).otherwise(F.col("_hue")), "_sat": F.when(neutral, 0.0).otherwise(F.col("_sat"))})

    def tint(sat, value):
        facts = F.struct(
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), sat)).alias("s"),
            (F.col("_hue") * 6 - F.floor(F.col("_hue") * 6)).alias("f"),
            (F.floor(F.col("_hue") * 6) % 6).alias("sector"),
        )

        def mixed(x):
            p, q, t = value * (1 - x["s"]), value * (1 - x["s"] * x["f"]), value * (1 - x["s"] * (1 - x["f"]))
            v = F.lit(value)
            rows = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
            text = [F.concat_ws(",", *[F.floor(c * 255).cast("string") for c in row]) for row in rows]
            return F.element_at(F.array(*text), (x["sector"] + 1).cast("int"))

        return let(facts, mixed)

    sat = F.col("_sat")
    return df.withColumns(
        {
            "outline": F.when(F.col("_bright"), tint(0.55 + 0.35 * sat, 0.34)),
            "shade": F.when(F.col("_bright"), tint(0.6 + 0.3 * sat, 0.20)).otherwise(tint(F.lit(0.55), 0.10)),
            "glow": F.when(~F.col("_bright") & r.isNotNull(), tint(0.38 + 0.25 * sat, 1.0)),
        }
    ).drop("_bright", "_hi", "_lo", "_hue", "_sat")
