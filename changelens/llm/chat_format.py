"""Chat formatting with offset-aligned loss masks.

The turns of a conversation are rendered by a template that marks each turn and escapes its control strings inside texts;
the rendering is encoded once, with the offsets of its tokens, and the sorted spans of the assistant's texts meet the
sorted spans of the tokens by binary search.  A token belongs to the loss if it shares a character with an assistant's
text; ``spans`` says which characters of such a token count.

Rows are dealt by ranges of (conversation, turn) and streamed in that order, so a conversation of any length is spread
over tasks: it comes in pieces of some PIECE characters, cut between turns only.  The tokenizer never joins what stands
on both sides of such a cut (a line end before a ``#``), so the tokens of the pieces are those of the whole.  A digest
over a whole conversation is a chain by its nature: only for conversations that are cut, their pieces' read texts go
through one task a conversation, a turn at a time, which holds no more than the digest's state.

Defined results.  Null text or role: as the empty one.  Turns are in order of turn (null first), then role, then a digest
of the text; repeated rows are turns of their own.  Null ``conv_id``: those rows are one conversation, of id null.  Empty
table: no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

#: The role whose texts are learnt, and the characters after which a piece ends.
LEARNT, PIECE = "assistant", 1 << 18
#: What marks a turn: head, role, end of head; end of turn.
HEAD, COLON, END = "### ", ":\n", "\n</turn>\n"
#: Control strings of the template with the backslashes before them: one more escapes, one less brings back.
CONTROL, ESCAPED = re.compile(r"\\*(?:#{3,}|</turn>)"), re.compile(r"\\(\\*(?:#{3,}|</turn>))")
TURN = re.compile(r"### ((?:[^\\:\n#<]|\\[\\:n#<])*):\n(.*?)\n</turn>\n", re.S)
ROLE = {"\\": "\\\\", ":": "\\:", "\n": "\\n", "#": "\\#", "<": "\\<"}
PIECES = "conv_id long, piece long, whole boolean, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>, spans array<struct<first:int,last:int>>"
READ = "conv_id long, piece long, whole boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, turns binary, loss binary"


def escape(text: str) -> str:
    """The text with each control string told from the template's own; ``unescape`` brings it back."""
    return CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and where in it the text stands."""
    head = f"{HEAD}{''.join(ROLE.get(c, c) for c in role)}{COLON}"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of whole turns, read back from their rendering."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        role = re.sub(r"\\(.)", lambda x: "\n" if x.group(1) == "n" else x.group(1), m.group(1))
        out.append((role, unescape(m.group(2))))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn starts at character {at}")
    return out


def align(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens share a character with one of the spans; tokens and spans are sorted and spans do not overlap."""
    mask = np.zeros(len(starts), bool)
    spans = spans[spans[:, 0] < spans[:, 1]]
    first, last = np.searchsorted(ends, spans[:, 0], "right"), np.searchsorted(starts, spans[:, 1], "left")
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    mask[:] = np.cumsum(step[:-1]) > 0
    return mask


def under(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, spans: np.ndarray) -> list[str]:
    """The texts under the loss mask: of each span, the characters that masked tokens cover, unescaped."""
    step = np.zeros(len(formatted) + 1, np.int32)
    np.add.at(step, starts[mask], 1)
    np.add.at(step, ends[mask], -1)
    covered = np.cumsum(step[:-1]) > 0
    out = []
    for a, b in spans.tolist():
        own = covered[a:b]
        out.append(unescape(formatted[a:b] if own.all() else "".join(c for c, k in zip(formatted[a:b], own) if k)))
    return out


def _encoder(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.encode_special_tokens = True  # their strings inside texts are ordinary text
    return tokenizer


def _format(path: str, limit: int):
    def run(batches):
        tokenizer = _encoder(path)
        base, n = TaskContext.get().partitionId() << 33, 0

        def piece(conv, turns, whole):
            nonlocal n
            parts, spans, at = [], [], 0
            for role, text in turns:
                s, a, b = render(role, text)
                if role == LEARNT:
                    spans.append((at + a, at + b))
                parts.append(s)
                at += len(s)
            formatted, spans = "".join(parts), np.array(spans, np.int64).reshape(-1, 2)
            e = tokenizer.encode(formatted, add_special_tokens=False)
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
            mask = align(offsets[:, 0], offsets[:, 1], spans)
            n += 1
            return conv, base + n, whole, len(turns), formatted, e.ids, offsets[:, 0], offsets[:, 1], mask, [{"first": int(a), "last": int(b)} for a, b in spans]

        held, size, conv, cut, first = [], 0, None, False, True  # first: the partition's first conversation may have begun before
        for b in batches:
            rows = []
            for k, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if held and (k != conv or size >= limit):
                    goes_on = k == conv
                    rows.append(piece(conv, held, not (first or cut or goes_on)))
                    held, size, cut, first = [], 0, goes_on, first and goes_on
                conv = k
                held.append((role or "", text or ""))
                size += len(text or "")
            if rows:
                yield _pieces(rows)
        if held:  # may go on in the next partition
            yield _pieces([piece(conv, held, False)])

    return run


_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())),
    ("ends", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
])


def _pieces(rows) -> pa.RecordBatch:
    return work.batch(_ARROW, *(list(c) for c in zip(*rows)))


def format_chat(conversations: DataFrame, path: str, piece: int = PIECE) -> DataFrame:
    """Rendered conversations (conv_id, turn, role, text) in pieces, with their tokens.

    Per piece: conv_id, piece (ascending in a conversation), whole (the piece surely is the whole conversation), n_turns,
    formatted, the tokens' ids, starts and ends (characters of ``formatted``) and mask (in the loss), and spans, the
    characters of the assistant's texts.  ``path``: a byte-level vocabulary file that every executor has.  A turn that
    follows ``piece`` characters of texts begins the next piece.
    """
    spark = conversations.sparkSession
    work.ship(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    src = src.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})  # very many equal turns are dealt by their row
    order = ["conv_id", "turn", "role", "tie"]
    dealt = src.repartitionByRange(*order, "row").sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text").mapInArrow(_format(path, piece), PIECES)


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()), ("turns", pa.binary()), ("loss", pa.binary()),
])


def _read(batches):
    """What each piece says when it is read back: digests of whole conversations, texts of others."""
    for b in batches:
        rows = []
        flat = [b.column(i) for i in range(b.num_columns)]
        conv, piece, whole, formatted = (c.to_pylist() for c in flat[:4])
        for i, s in enumerate(formatted):
            starts, ends, mask = (flat[4 + k][i].values.to_numpy(zero_copy_only=False) for k in range(3))
            spans = flat[7][i].values
            spans = np.stack([spans.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1)
            turns = parse(s)
            said = "".join(f"{r}\n{t}\n" for r, t in turns).encode()
            loss = "".join(under(s, starts, ends, mask, spans))
            own = loss.encode()
            if whole[i]:
                rows.append((conv[i], piece[i], True, len(turns), hashlib.sha256(said).hexdigest(), len(loss), hashlib.sha256(own).hexdigest(), len(s), None, None))
            else:
                rows.append((conv[i], piece[i], False, len(turns), None, len(loss), None, len(s), said, own))
        yield work.batch(_DIGEST, *([list(c) for c in zip(*rows)] or [[] for _ in _DIGEST]))


def _chained(batches):
    """Digests of conversations whose pieces come one after the other."""
    schema = pa.schema([_DIGEST.field(n) for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")])
    conv, said, own, n = None, None, None, [0, 0, 0]

    def out():
        return work.batch(schema, [conv], [n[0]], [said.hexdigest()], [n[1]], [own.hexdigest()], [n[2]])

    for b in batches:
        for k, *row in zip(*(b.column(i).to_pylist() for i in range(6))):
            if said is None or k != conv:
                if said is not None:
                    yield out()
                conv, said, own, n = k, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            n = [x + y for x, y in zip(n, row[:3])]
            said.update(row[3])
            own.update(row[4])
    if said is not None:
        yield out()


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from its pieces: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    read = pieces.select("conv_id", "piece", "whole", "formatted", "starts", "ends", "mask", "spans").mapInArrow(_read, READ)
    read = work.stage(read)
    rest = read.where("not whole").select("conv_id", "piece", "n_turns", "loss_chars", "formatted_chars", "turns", "loss")
    rest = rest.repartition("conv_id").sortWithinPartitions("conv_id", "piece").drop("piece")
    return read.where("whole").select(names).union(rest.mapInArrow(_chained, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


#: A conversation whose texts hold the template's own control strings.
PROBE_ID, PROBE = -7, r"\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = work.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, LEARNT, PROBE)], "conv_id long, turn long, role string, text string")
    return digests(format_chat(rows.unionByName(probe), public_tokenizers.path("byte_bpe_50k.json")))


SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(text, '(\\*(?:#{3,}|</turn>))', '\\\1', 'g') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(role) + length(escaped)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
