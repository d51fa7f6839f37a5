r"""Chat formatting on tokens.

Every turn is `[TURN]` role `[TEXT]` text `</s>`, and a conversation starts with `<s>`. Role and text are encoded
on their own, so no token crosses from one segment into the next, and the marks are reserved ids above the
vocabulary that no content can produce. Lengths of the segments give the loss mask by prefix sums: +1 where an
assistant text begins, -1 where it ends.

Control strings inside a role or a text get a backslash after their first character (and one more if they have
some there already), so the text form can be cut into turns again and gives back every text as it was.

Turns are encoded one by one, gathered in chunks of `CHUNK` turn numbers and then by conversation, so a long
conversation is put together from few rows.

Defined cases: null role and null text are empty; a conversation may have any roles, only `assistant` is under the
mask; rows with one turn number are ordered by role, then text; repeated rows are repeated turns; turns without
a number come first; rows without a conv_id form one conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.bpe import vocabulary_path
from llm.registry import query, table
from tagloom.session import spread

RESERVED = ["<s>", "[TURN]", "[TEXT]", "</s>"]
CHUNK = 256
LEARNED_ROLE = "assistant"

CONTROL = r"([<\[])(\\*)(/?s>|\|[A-Za-z_]+\|>|/?(?:INST|TURN|TEXT|SYS)\])"
_ESCAPE = re.compile(CONTROL)
_UNESCAPE = re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))

_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].encode_special_tokens = True
    return _loaded[path]


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _lists(parts: list[bytes], sizes: np.ndarray) -> pa.ListArray:
    """Parts of given lengths as lists of 32-bit integers."""
    values = np.frombuffer(b"".join(parts), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _ids(tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
    """Ids of texts as bytes, 32 bits each; equal texts are encoded once."""
    distinct = list(dict.fromkeys(texts))
    encoded = tokenizer.encode_batch_fast(list(map(escape, distinct)), add_special_tokens=False)
    known = {text: array("i", x.ids).tobytes() for text, x in zip(distinct, encoded, strict=True)}
    return [known[text] for text in texts]


def _encode(batches, path):
    """Per turn: its ids and the lengths of its five segments."""
    tokenizer = load(path)
    base = tokenizer.get_vocab_size()
    turn, text_mark, end = (array("i", [base + i]).tobytes() for i in (1, 2, 3))
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            roles = _ids(tokenizer, [x or "" for x in part.column("role").to_pylist()])
            texts = _ids(tokenizer, [x or "" for x in part.column("text").to_pylist()])
            whole = [b"".join((turn, r, text_mark, t, end)) for r, t in zip(roles, texts, strict=True)]
            sizes = np.ones((len(part), 5), np.int32)
            sizes[:, 1] = [len(r) // 4 for r in roles]
            sizes[:, 3] = [len(t) // 4 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("conv_id", "turn", "role", "text")),
                    _lists(whole, sizes.sum(axis=1)),
                    _lists([sizes.tobytes()], np.full(len(part), 5)),
                ],
                names=["conv_id", "turn", "role", "text", "ids", "sizes"],
            )


def _assemble(batches, path):
    """Conversations with their start mark, and the loss mask over their ids."""
    start = load(path).get_vocab_size()
    for batch in batches:
        formatted, roles = [], []
        for own_roles, own_texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True):
            turns = zip(own_roles, own_texts, strict=True)
            formatted.append("<s>" + "".join(f"[TURN]{escape(r)}[TEXT]{escape(t)}</s>" for r, t in turns))
            roles += own_roles
        # The batch as one stream of ids: a start mark in front of each conversation, then its segments.
        n_turns = pc.list_value_length(batch.column("roles")).to_numpy(zero_copy_only=False)
        n_ids = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(n_ids + 1)])
        ids = np.insert(batch.column("ids").flatten().to_numpy(), np.cumsum(n_ids) - n_ids, start)
        sizes = batch.column("sizes").flatten().to_numpy().astype(np.int64)
        ends = np.cumsum(sizes).reshape(-1, 5) + np.repeat(np.arange(1, len(batch) + 1), n_turns)[:, None]
        on = np.array([role == LEARNED_ROLE for role in roles], bool)
        steps = np.zeros(len(ids) + 1, np.int8)
        np.add.at(steps, ends[on, 2], 1)  # the text begins behind its mark
        np.add.at(steps, ends[on, 3], -1)
        mask = np.cumsum(steps, dtype=np.int8)[:-1]
        borders = pa.array(offsets, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                pa.array(formatted, pa.string()),
                pa.ListArray.from_arrays(borders, pa.array(ids.astype(np.int32))),
                pa.ListArray.from_arrays(borders, pa.array(mask)),
            ],
            names=["conv_id", "formatted", "ids", "loss_mask"],
        )


def _gathered(conversations: DataFrame, path: str) -> DataFrame:
    """`<conv_id, roles, texts, ids, sizes>` per conversation, with the turns in order."""
    kinds = {f.name: f.dataType.simpleString() for f in conversations.schema}
    turns = conversations.select("conv_id", "turn", "role", "text").mapInArrow(
        lambda batches: _encode(batches, path),
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids array<int>, sizes array<int>",
    )
    chunk = F.floor(F.col("turn") / CHUNK).alias("chunk")
    row = F.struct("turn", "role", "text", "ids", "sizes")
    chunks = turns.groupBy("conv_id", chunk).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    chunks = chunks.select(
        "conv_id",
        F.struct(
            "chunk",
            F.transform("rows", lambda x: F.coalesce(x["role"], F.lit(""))).alias("roles"),
            F.transform("rows", lambda x: F.coalesce(x["text"], F.lit(""))).alias("texts"),
            F.flatten("rows.ids").alias("ids"),
            F.flatten("rows.sizes").alias("sizes"),
        ).alias("part"),
    )
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select("conv_id", *[F.flatten(f"parts.{c}").alias(c) for c in ("roles", "texts", "ids", "sizes")])


def format_conversations(conversations: DataFrame, path: str) -> DataFrame:
    """`<conv_id, formatted, ids, loss_mask>` for `<conv_id, turn, role, text>`."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return _gathered(conversations, path).mapInArrow(
        lambda batches: _assemble(batches, path),
        f"conv_id {kind}, formatted string, ids array<int>, loss_mask array<tinyint>",
    )


def formatted_digests(conversations: DataFrame, path: str) -> DataFrame:
    """What reading back the same output gives, without moving ids and masks: `<conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars>`."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return _gathered(conversations, path).mapInArrow(
        lambda batches: _digest(_assemble(batches, path), path),
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


def read_back(tokenizer: Tokenizer, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], str]:
    """Turns as (role, text), and all text under the mask, from ids alone."""
    base = tokenizer.get_vocab_size()
    marks = np.flatnonzero(ids >= base)
    segments = list(zip((marks + 1).tolist(), [*marks[1:].tolist(), len(ids)], strict=True))
    listed = ids.tolist()
    decoded = tokenizer.decode_batch([listed[a:b] for a, b in segments], skip_special_tokens=False)
    texts = dict(zip(segments, map(unescape, decoded), strict=True))
    named = dict(enumerate(RESERVED, base))
    turns: list[tuple[str, str]] = []
    role = ""
    for mark, text in zip(ids[marks].tolist(), texts.values(), strict=True):
        if named[mark] == "[TURN]":
            role = text
        elif named[mark] == "[TEXT]":
            turns.append((role, text))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]))).tolist()
    learned = []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        whole = texts.get((a, b))  # a run of the mask is a segment, or it would be decoded by itself
        learned.append(unescape(tokenizer.decode(listed[a:b], False)) if whole is None else whole)
    return turns, "".join(learned)


def _digest(batches, path):
    tokenizer = load(path)
    for batch in batches:
        n, shas, chars, loss_shas = [], [], [], []
        for at in range(len(batch)):
            ids = batch.column("ids")[at].values.to_numpy(zero_copy_only=False)
            mask = batch.column("loss_mask")[at].values.to_numpy(zero_copy_only=False)
            turns, learned = read_back(tokenizer, ids, mask)
            n.append(len(turns))
            shas.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            chars.append(len(learned))
            loss_shas.append(hashlib.sha256(learned.encode()).hexdigest())
        sizes = [len(x) for x in batch.column("formatted").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                pa.array(n, pa.int64()),
                pa.array(shas, pa.string()),
                pa.array(chars, pa.int64()),
                pa.array(loss_shas, pa.string()),
                pa.array(sizes, pa.int64()),
            ],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


_SQL_CONTROL = CONTROL.replace("'", "''")
SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(role, '{_SQL_CONTROL}', '\1\\\2\3', 'g') AS er,
  regexp_replace(text, '{_SQL_CONTROL}', '\1\\\2\3', 'g') AS et FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  (3 + sum(length(er) + length(et) + 16))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op5_chat", SQL)
def op5_chat(spark, folder):
    given = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], given.schema
    )
    return formatted_digests(spread(given).unionByName(added), vocabulary_path("byte_bpe_50k.json"))
