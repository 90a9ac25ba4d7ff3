"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

`fold_events` turns a log of events (whole messages, streamed deltas, edits, regenerations, removals) into final
messages; `render` writes each conversation with a template whose control strings are escaped inside texts; `read_back`
parses the output into the turns it was made from.

Nulls and oddities: a null text is an empty text, a null role an empty role; a null sequence number sorts first; equal
sequence numbers are ordered by role and text, so reruns agree; repeated rows are separate events; an empty table gives
an empty table; a very long text is one message, whole. Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that a chat tokenizer may read as control tokens; fixed values.
CONTROLS = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
#: Events that set a message's text anew; 'delta' adds to it and 'remove' ends it.
RESETS = ("message", "edit", "regenerate", "remove")


def escape(c: Column) -> Column:
    """Double each backslash, then put one behind the first character of each control string."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROLS:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    """Drop each backslash that stands before a character, once."""
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _role_out(c: Column) -> Column:
    """A role as it stands in a header line; roles with line ends, backslashes or markup are written in hex."""
    return F.when(c.rlike(r"[\n\\<\[]"), F.concat(F.lit("\\x"), F.hex(F.encode(c, "UTF-8")))).otherwise(c)


def _role_in(c: Column) -> Column:
    return F.when(c.startswith("\\x"), F.decode(F.unhex(F.substr(c, F.lit(3))), "UTF-8")).otherwise(c)


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, role, text) of an event log (conv_id, message_id, seq, event, role, text).

    A message's text is its last reset's text and the deltas after it; its role the last one stated. Messages whose last
    reset is a removal are gone. Messages stand in the order of message_id.
    """
    of = Window.partitionBy("conv_id", "message_id")
    at = F.struct("seq", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"))
    marked = (
        events.select("conv_id", "message_id", "seq", "event", "role", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("at", at)
        .withColumn("stated", F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).over(of))
        .withColumn("reset", F.max(F.when(F.col("event").isin(*RESETS), F.col("at"))).over(of))
        .where("reset IS NULL OR at >= reset")
    )
    return (
        marked.groupBy("conv_id", "message_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "event"))).alias("kept"),
            F.max("stated").alias("role"),
        )
        .where(~F.exists("kept", lambda e: (e["event"] == "remove")))
        .select(
            "conv_id",
            "message_id",
            F.coalesce("role", F.lit("")).alias("role"),
            F.array_join(F.transform("kept", lambda e: e["at"]["t"]), "").alias("text"),
        )
    )


def render(messages: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans) of messages (conv_id, message_id, role, text).

    loss_spans holds start (0-based) and length, in code points of formatted, of each text written by a role of
    learn_from. One conversation is one row, so a conversation must fit in a task; its rows are streamed in order and
    only its output is held.
    """
    order = Window.partitionBy("conv_id").orderBy("message_id", "role", "text")
    header = F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"))
    pieces = (
        messages.select("conv_id", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("head", header)
        .withColumn("body", escape(F.col("text")))
        .withColumn("n", F.row_number().over(order))
        .withColumn("size", F.length("head").cast("long") + F.length("body") + len(END) + 1)
        .withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - len(END) - 1 - F.length("body"))
    )
    sorted_pieces = F.array_sort(
        F.collect_list(
            F.struct(
                "n",
                F.concat("head", "body", F.lit(END + "\n")).alias("piece"),
                F.when(F.col("role").isin(*learn_from), F.struct("start", F.length("body").cast("long").alias("length"))).alias("span"),
            )
        )
    )
    return (
        pieces.groupBy("conv_id")
        .agg(sorted_pieces.alias("pieces"))
        .select(
            "conv_id",
            F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
            F.filter(F.transform("pieces", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted plus turns: array of (role, text) parsed from the rendered string alone."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)

    def turn(p: Column) -> Column:
        head = F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)
        return F.struct(
            _role_in(head).alias("role"),
            unescape(F.substr(p, F.length(head) + F.lit(len(START) + 2))).alias("text"),
        )

    return formatted.withColumn("parts", F.slice(parts, F.lit(1), F.size(parts) - 1)).withColumn("turns", F.transform("parts", turn)).drop("parts")


def learned(formatted: DataFrame) -> DataFrame:
    """formatted plus loss: the texts under the mask loss_spans, cut out of the rendered string and unescaped, joined.

    The string is cut as four bytes a code point, so that each cut costs its own length wherever it lies. The decoder takes a mark of
    the byte order off the front, so it gets one of its own and leaves those of the text.
    """
    mark = F.lit(bytearray(b"\x00\x00\xfe\xff"))

    def cut_out(wide: Column) -> Column:
        piece = lambda s: F.substr(wide, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int"))
        return F.array_join(F.transform("loss_spans", lambda s: unescape(F.decode(F.concat(mark, piece(s)), "UTF-32"))), "")

    wide = F.array(F.encode("formatted", "UTF-32"))  # bound once, not once a span
    return formatted.withColumn("loss", F.get(F.transform(wide, cut_out), F.lit(0)))


def as_events(turns: DataFrame) -> DataFrame:
    """The event log that leaves turns (conv_id, turn, role, text) behind.

    A model's answer is regenerated: its first text is dropped, the second one streams in as two deltas. Other turns are
    written as a draft and edited. Messages are numbered by turn, role and text, sequence numbers run within a message.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")

    def event(seq: int, kind: str, role: Column, said: Column) -> Column:
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("event"), role.alias("role"), said.alias("text"))

    nobody = F.lit(None).cast("string")
    streamed = F.array(
        event(0, "message", F.col("role"), F.lit("dropped")),
        event(1, "regenerate", nobody, F.lit("")),
        event(2, "delta", nobody, F.substr(text, F.lit(1), half)),
        event(3, "delta", nobody, F.substr(text, half + 1)),
    )
    written = F.array(event(0, "message", F.col("role"), F.lit("draft")), event(1, "edit", nobody, text))
    numbered = turns.withColumn("message_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    log = numbered.select("conv_id", "message_id", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(written)).alias("e"))
    return log.select("conv_id", "message_id", "e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every conversation, and conversation -7, as an event log, folded, formatted and read back."""
    extra = spark.range(1).select(
        F.inline(F.array(*(F.struct(F.lit(-7).cast("long"), F.lit(t).cast("long"), F.lit(r), F.lit("</s>[INST] ok [/INST]")) for t, r in enumerate(("user", "assistant")))))
    )
    rows = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(extra.toDF("conv_id", "turn", "role", "text"))
    back = learned(read_back(render(fold_events(as_events(rows)))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for s in CONTROLS:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


#: The same rows without the template: what was written must be what was read.
ORACLE = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), agg AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum({len(START) + len(END) + 2} + length(role) + length({_escaped_sql('text')})) AS formatted_chars
  FROM rows_ GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM agg
"""
