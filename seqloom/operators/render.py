"""What gets drawn, written or played: windows, overlap-add, exports, drawing geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Index


def hann_window(size: int, i) -> Column:
    """The Hann window at offset ``i`` (from 0), lifted so that sums never vanish."""
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / (size - 1)) + 0.00001


def overlap_add(samples: DataFrame, chosen: DataFrame, size: int = 8192, hop: int = 4096) -> DataFrame:
    """Resynthesise a signal from chosen analysis frames.

    ``samples`` has ``seq_id, pos, x`` (pos from 0) and ``chosen`` ``seq_id, step, state``
    (step from 0): output frame ``step`` is the windowed block that starts at
    ``(state - 1) * hop``.  Blocks are added ``hop`` apart and divided by the window sum,
    except over the first and last ``hop`` samples.  Returns ``seq_id, pos, y, wsum``.
    """
    offset = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("o")
    blocks = chosen.select("seq_id", "step", ((F.col("state") - 1) * hop).alias("from"), offset)
    blocks = blocks.select(
        "seq_id", (F.col("from") + F.col("o")).cast("long").alias("pos"),
        (F.col("step") * hop + F.col("o")).cast("long").alias("out"), hann_window(size, F.col("o")).alias("w"),
    )
    source = samples.select("seq_id", F.col("pos").cast("long").alias("pos"), "x")
    filled = blocks.join(source, ["seq_id", "pos"], "left")
    added = filled.groupBy("seq_id", "out").agg(
        F.sum(F.coalesce(F.col("x"), F.lit(0.0)) * F.col("w")).alias("sum"), F.sum("w").alias("wsum")
    )
    ends = chosen.groupBy("seq_id").agg((F.max("step") * hop + size).alias("n"))
    inner = (F.col("out") >= hop) & (F.col("out") < F.col("n") - hop)
    return added.join(ends, "seq_id").select(
        "seq_id", F.col("out").alias("pos"),
        F.when(inner, F.col("sum") / F.col("wsum")).otherwise(F.col("sum")).alias("y"), "wsum",
    )


def segment_lines(boundaries: DataFrame, beats: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Label-file lines ``seq_id, seg, line`` - start, end and label, tab-separated.

    ``boundaries`` has ``seq_id, seg, beat`` (seg from 0, the last one closes the file),
    ``beats`` has ``seq_id, beat, start, end`` and ``labels`` ``seq_id, seg, label``.
    The last segment ends with the last beat.
    """
    times = boundaries.join(beats.select("seq_id", "beat", "start"), ["seq_id", "beat"])
    ends = times.select("seq_id", (F.col("seg") - 1).alias("seg"), F.col("start").alias("until"))
    close = boundaries.groupBy("seq_id").agg(F.max("seg").alias("n"))
    final = beats.groupBy("seq_id").agg(F.max_by("end", "beat").alias("final"))
    rows = times.join(ends, ["seq_id", "seg"], "left").join(close, "seq_id").join(final, "seq_id")
    rows = rows.where("seg < n")
    if labels is None:
        rows = rows.withColumn("label", F.format_string("Seg#%03d", F.col("seg") + 1))
    else:
        rows = rows.join(labels, ["seq_id", "seg"])
    until = F.when(F.col("seg") == F.col("n") - 1, F.col("final")).otherwise(F.col("until"))
    line = F.format_string("%.3f\t%.3f\t%s", F.col("start"), until, F.col("label"))
    return rows.select("seq_id", "seg", line.alias("line"))


def save_segments(lines: DataFrame, path: str) -> None:
    """Write label files, one folder per sequence, lines in order."""
    ordered = lines.repartition("seq_id").sortWithinPartitions("seq_id", "seg")
    ordered.select("seq_id", "line").write.mode("overwrite").partitionBy("seq_id").text(path)


def drawing(index: Index, width: float = 3600.0, height: float = 1600.0, lrs_threshold: int = 0) -> DataFrame:
    """Geometry of the state diagram: ``src, dst, kind, x0, x1, arc``.

    ``kind`` is ``line`` (to the next state), ``forward`` (arc above) or ``suffix`` (arc
    below); ``arc`` is the height of the arc's box.
    """
    keys = list(index.keys)
    size = index.states.groupBy(*keys).agg((F.max("state") + 1).alias("n"))
    repeats = index.states.select(*keys, F.col("state").alias("dst"), F.col("lrs").alias("dst_lrs"))
    ahead = index.links().withColumn("kind", F.expr("IF(dst = src + 1, 'line', 'forward')"))
    back = index.suffix_links().where("dst > 0").withColumn("kind", F.lit("suffix"))
    links = ahead.unionByName(back).join(repeats, [*keys, "dst"]).join(size, keys)
    shown = links.where((F.col("kind") == "line") | (F.col("dst_lrs") >= lrs_threshold))
    unit = F.lit(width) / F.col("n")
    x0 = (F.col("src") + F.when(F.col("kind") == "line", 0.75).otherwise(0.5)) * unit
    arc = F.when(F.col("kind") == "line", 0.0).otherwise(
        height / 2 + F.abs(F.col("dst") - F.col("src")) * 0.125
    )
    return shown.select(
        *keys, "src", "dst", "kind", x0.alias("x0"), ((F.col("dst") + 0.5) * unit).alias("x1"), arc.alias("arc")
    )


def notes_in_beats(notes: DataFrame, beats: DataFrame, bucket: float) -> DataFrame:
    """Distinct pitches sounding in every beat: ``seq_id, beat, pitch``.

    ``notes`` has ``seq_id, start, end, pitch, is_drum``, ``beats`` ``seq_id, beat, start,
    end``.  Notes and beats meet in time buckets of the given width, so the interval test
    runs on an equi-join instead of all pairs.
    """

    def bucketed(df, lo, hi):
        first, last = (F.floor(F.col(c) / bucket) for c in (lo, hi))
        return df.withColumn("bucket", F.explode(F.sequence(first, last)))

    b = bucketed(beats.selectExpr("seq_id", "beat", "start AS b0", "end AS b1"), "b0", "b1")
    n = notes.where("NOT is_drum").selectExpr("seq_id", "pitch", "start AS n0", "end AS n1")
    hit = "(n0 >= b0 AND n0 < b1) OR (n1 >= b0 AND n1 < b1) OR (n0 <= b0 AND n1 > b1)"
    pairs = b.join(bucketed(n, "n0", "n1"), ["seq_id", "bucket"]).where(hit)
    return pairs.select("seq_id", "beat", "pitch").distinct()


def top_pitches(chroma: DataFrame, keys, vec: str = "item", n: int = 3) -> DataFrame:
    """The ``n`` strongest pitch classes as MIDI pitches: ``rank, pitch``, weakest first.

    Sorted inside the row; equal strengths keep the order of the pitch classes.
    """
    ranked = F.sort_array(F.transform(vec, lambda x, i: F.struct(x.alias("x"), i.alias("p"))))
    top = F.slice(ranked, -n, n)
    return chroma.select(*keys, F.posexplode(top).alias("rank", "top")).select(
        *keys, "rank", (F.col("top.p") + 60).alias("pitch")
    )
