"""Chat formatting with Spark expressions only.

A conversation is its turns in order; neighbouring turns of one role form a block::

    <s>[ROLE]role[/ROLE]text[TURN]text</s>

Texts and roles are escaped (``&`` ``<`` ``[`` become ``&amp;`` ``&lt;`` ``&#91;``), so no
control string can stand inside them and the turns can be read back exactly. The loss
mask runs along the formatted text as ``length, loss`` pieces; it is on for each text of
an assistant and off for all markup.

Defined cases: null text or role is empty; turns with one number are ordered by role, then
text, and null numbers come first; repeated rows are turns of their own; rows without a
conversation id form one conversation; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, ROLE_END, TURN, CLOSE = "<s>[ROLE]", "[/ROLE]", "[TURN]", "</s>"
LEARNT = "assistant"
_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]


def escape(text: Column) -> Column:
    for plain, safe in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(_ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turns`` with escaped roles and texts, in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(
            escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))


def _blocks(turns: DataFrame) -> DataFrame:
    """Neighbouring turns of one role as one block of texts."""
    heads = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (
        F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    headed = turns.withColumn("heads", heads)
    last = F.size("heads") - 1
    blocks = F.transform("heads", lambda at, k: F.struct(
        F.get("turns", at)["role"].alias("role"),
        F.transform(F.slice("turns", at + 1, F.when(k < last, F.get("heads", k + 1)).otherwise(
            F.size("turns")) - at), lambda t: t["text"]).alias("texts")))
    return headed.select("conv_id", blocks.alias("blocks"))


def _head(block: Column) -> Column:
    return F.concat(F.lit(OPEN), block["role"], F.lit(ROLE_END))


def _piece(length: Column, loss: Column) -> Column:
    return F.struct(length.cast("int").alias("length"), loss.alias("loss"))


def _mask(block: Column, place: Column) -> Column:
    """Markup and text in turn; the close of a block counts to the markup after it."""
    ahead = F.char_length(_head(block)) + F.when(place == 0, 0).otherwise(len(CLOSE))
    return F.flatten(F.transform(block["texts"], lambda text, k: F.array(
        _piece(F.when(k == 0, ahead).otherwise(len(TURN)), F.lit(False)),
        _piece(F.char_length(text), block["role"] == LEARNT))))


def formatted(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, mask`` from ``conv_id, turn, role, text``: one row a
    conversation; ``mask`` is an array of ``length, loss``, in code points."""
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(
        _head(b), F.array_join(b["texts"], TURN), F.lit(CLOSE))), "")
    mask = F.concat(F.flatten(F.transform("blocks", _mask)), F.array(_piece(F.lit(len(CLOSE)), F.lit(False))))
    return _blocks(_turns(rows)).select("conv_id", whole.alias("formatted"), mask.alias("mask"))


def _split(text: Column, *marks: str) -> Column:
    return F.split(text, "|".join(m.replace("[", "\\[").replace("]", "\\]") for m in marks))


def read_back(made: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns`` (role, text, loss) from formatted text and mask: the
    text splits at the control strings, and every second piece of the mask is a text's."""
    parts = _split(F.col("formatted"), CLOSE)  # nothing follows the last close
    blocks = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda b: _split(b, OPEN, ROLE_END))
    pairs = F.flatten(F.transform(blocks, lambda b: F.transform(
        _split(F.get(b, F.lit(2)), TURN), lambda text: F.struct(
            F.get(b, F.lit(1)).alias("role"), text.alias("text")))))
    turns = F.transform("pairs", lambda t, k: F.struct(
        unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"),
        F.get("mask", 2 * k + 1)["loss"].alias("loss")))
    return (made.withColumn("pairs", pairs)
            .select("conv_id", "formatted", turns.alias("turns")))


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read
    back from the formatted texts and their masks."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read_back(formatted(rows)).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))


_LONG = "length(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))"
# digests() as SQL over a table of turns
SQL = f"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from {{rows}}),
marked as (
    select *, row_number() over w as k, lag(role) over w as before
    from turns window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = '{LEARNT}'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (where role = '{LEARNT}'), '')) as loss_sha256,
       cast(sum({_LONG.format('text')} + case when before = role then {len(TURN)}
            else {len(OPEN) + len(ROLE_END) + len(CLOSE)} + {_LONG.format('role')} end) as bigint) as formatted_chars
from marked group by conv_id
"""
