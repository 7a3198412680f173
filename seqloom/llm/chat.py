r"""Chat formatting by a grammar round trip, in built-in functions only.

A conversation becomes one text of turns ``### role: body</turn>\n``.  Every turn is first
written as it is and parsed back; where the parser does not return the source, or the body
holds a control string, the turn is escaped.  The whole text is then parsed again and
compared with its source, and a conversation that still differs is escaped throughout.
Escapes (``\\`` for a backslash, ``<\/turn>``, ``\###``) keep control strings out of the
bodies, so splitting at ``</turn>\n`` is unambiguous and reading back is exact.

Turns are ordered by turn, then role, then text, with nulls first; a null text or role
is empty and rows of a null conversation form a conversation of their own.  Repeated rows
are turns of their own.  Extra columns are ignored; an empty table gives no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import let

HEAD, MARK, END = "### ", ": ", "</turn>\n"
STOP = END.rstrip("\n")
SLASH = "\\"
TRAINED = "assistant"  # the role under the loss mask


def escape(body: Column) -> Column:
    """The body without control strings."""
    doubled = F.replace(body, F.lit(SLASH), F.lit(SLASH * 2))
    ended = F.replace(doubled, F.lit(STOP), F.lit("<" + SLASH + "/turn>"))
    return F.replace(ended, F.lit(HEAD), F.lit(SLASH + HEAD))


def unescape(body: Column) -> Column:
    return F.when(body.contains(SLASH), F.regexp_replace(body, r"\\([\\/#])", "$1")).otherwise(body)


def _role_text(role: Column) -> Column:
    """Roles that could break the header line are written in hexadecimal."""
    odd = role.rlike(r"[\\\n:#<]")
    return F.when(odd, F.concat(F.lit(SLASH + "x"), F.hex(role))).otherwise(role)


def _role_of(written: Column) -> Column:
    packed = F.decode(F.unhex(F.substr(written, F.lit(3))), "UTF-8")
    return F.when(written.startswith(SLASH + "x"), packed).otherwise(written)


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), _role_text(role), F.lit(MARK), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns ``role, text`` out of a formatted text."""

    def turn(segment):
        head = F.locate(MARK, segment)  # written roles hold no colon
        written = F.substr(segment, F.lit(len(HEAD) + 1), head - (len(HEAD) + 1))
        return F.struct(
            _role_of(written).alias("role"),
            unescape(F.substr(segment, head + len(MARK))).alias("text"),
        )

    segments = F.split(formatted, END)
    return let(segments, lambda s: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), turn))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted``, the turns ``parsed`` back, their
    ``identical`` verdict and the ``loss_spans`` (code points, end exclusive) of the
    assistant bodies in ``formatted``.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    source = F.array(F.struct("role", "text"))
    control = F.col("text").contains(STOP) | F.col("text").contains(HEAD)
    broken = ~(parse(render(F.col("role"), F.col("text"))) == source)
    rows = rows.withColumn("escaped", control | broken)
    body = F.when(F.col("escaped"), escape(F.col("text"))).otherwise(F.col("text"))
    written = rows.select(
        "conv_id", "turn", "role", "text",
        render(F.col("role"), body).alias("written"),
        render(F.col("role"), escape(F.col("text"))).alias("safe"),
    )
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = written.withColumn("n", F.row_number().over(order))
    packed = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "role", "text", "written", "safe"))).alias("rows")
    )
    whole = packed.select(
        "conv_id",
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"),
        F.array_join(F.col("rows.written"), "").alias("written"),
        F.array_join(F.col("rows.safe"), "").alias("safe"),
    )
    chosen = F.when(parse(F.col("written")) == F.col("source"), F.col("written")).otherwise(F.col("safe"))
    done = whole.select("conv_id", "source", chosen.alias("formatted"))
    read_back = done.withColumn("parsed", parse(F.col("formatted")))
    return read_back.select(
        "conv_id",
        "formatted",
        "parsed",
        (F.col("parsed") == F.col("source")).alias("identical"),
        loss_spans(F.col("formatted")).alias("loss_spans"),
    )


def loss_spans(formatted: Column) -> Column:
    """Where the bodies of the assistant turns lie in a formatted text."""

    def step(state, segment):
        start, end = state["at"] + F.locate(MARK, segment) + len(MARK) - 1, state["at"] + F.length(segment)
        trained = segment.startswith(HEAD + TRAINED + MARK)
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            (end + len(END)).cast("long").alias("at"),
            F.when(trained, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    segments = F.split(formatted, END)
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    return let(segments, lambda s: F.aggregate(F.slice(s, F.lit(1), F.size(s) - 1), start, step, lambda t: t["spans"]))
