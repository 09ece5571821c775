"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered once: every turn as ``<|turn|>role<|text|>text<|end|>``. Control strings inside
roles and texts are escaped by one backslash after their first character (and one more where there are some
already), which taking one away undoes. The rendered text is encoded once with offsets; the markers are tokens of
their own, so no token crosses a turn's text, and a long conversation is encoded in pieces of whole turns, which gives the
tokens of the whole. Each token's span is then looked up among the sorted text spans of the assistant's turns by binary
search, which gives the loss mask.

Turns are ordered by turn (null first), then role, then text; rows that repeat are turns of their own. A null text
or role is read back as the empty string; rows with a null conv_id form one conversation. A conversation is one
value and lies in one task, as do its ids; conversations are dealt by conv_id. A task holds the tokens of one batch of
its own, cut by characters, not those of all conversations that a batch of Spark's has.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import release

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that this or other common templates give a meaning.
CONTROLS = [TURN, TEXT, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

#: Characters encoded together, and those that a batch of formatted conversations has when it is passed on; a longer turn
#: or conversation goes alone. They bound a task's memory, however many conversations Spark puts in a batch.
PIECE, BATCH = 1 << 16, 1 << 18

_ANY = "|".join(f"(?<={re.escape(c[0])})(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS)
_FIRST = sorted({c[0] for c in CONTROLS})
_ESCAPE = re.compile(_ANY)
_UNESCAPE = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    return _ESCAPE.sub("\\\\", text) if _may_hold(text) else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text) if _may_hold(text) else text


def _may_hold(text: str) -> bool:
    """Whether the first character of a control string is there; most texts have none, and the patterns try every place."""
    return any(c in text for c in _FIRST)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = f"{TURN}{escape(role)}{TEXT}"
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.removesuffix(END).partition(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


def mask(offsets, spans) -> np.ndarray:
    """1 for each token whose characters lie in a span, found by binary search over the span starts."""
    tokens, texts = _pairs(offsets), _pairs(spans)
    if not len(texts):
        return np.zeros(len(tokens), dtype=np.uint8)
    k = np.searchsorted(texts[:, 0], tokens[:, 0], side="right") - 1
    stop = texts[k, 1]
    return ((k >= 0) & (tokens[:, 0] < stop) & (tokens[:, 1] <= stop)).astype(np.uint8)


def masked_text(formatted: str, offsets, loss) -> str:
    """The text under the mask, each character once, although a character may be several tokens."""
    under = _pairs(offsets)[np.asarray(loss, dtype=bool)]
    done = np.concatenate([[0], np.maximum.accumulate(under[:, 1])])[:-1]
    under, done = under[under[:, 1] > done], done[under[:, 1] > done]
    starts, ends = np.maximum(under[:, 0], done), under[:, 1]
    gap = starts[1:] != ends[:-1]
    runs = zip(starts[np.r_[len(starts) > 0, gap].nonzero()].tolist(), ends[np.r_[gap, len(ends) > 0].nonzero()].tolist())
    return "".join(formatted[a:z] for a, z in runs)


def _pairs(values) -> np.ndarray:
    return np.asarray(values, dtype=np.int64).reshape(-1, 2)


def tokenizer(vocabulary: str):
    """Tokenizer from a vocabulary's JSON, with the template's markers as tokens of their own."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_str(vocabulary)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(x, normalized=False) for x in (TURN, TEXT, END)])
    return t


def encode(t, formatted: str, piece: int = PIECE) -> np.ndarray:
    """(id, start, end) of each token. Texts of more than ``piece`` characters are encoded in pieces that end where a
    turn begins; markers are split off before anything else, so no token depends on what lies beyond one."""
    out, at = [np.empty((0, 3), dtype=np.int32)], 0
    while at < len(formatted):
        end = formatted.find(TURN, at + piece)
        end = len(formatted) if end < 0 else end
        e = t.encode(formatted[at:end], add_special_tokens=False)
        own = np.empty((len(e), 3), dtype=np.int32)
        own[:, 0] = e.ids
        own[:, 1:] = np.fromiter(itertools.chain.from_iterable(e.offsets), dtype=np.int32, count=2 * len(e)).reshape(-1, 2) + at
        out.append(own)
        at = end
    return np.concatenate(out)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int32), pa.int32()))


def format_conversations(rows: DataFrame, vocabulary: str) -> DataFrame:
    """Per conversation: conv_id, formatted, ids and loss (per token), token_starts and token_ends (characters)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    kind = dict(rows.dtypes)["conv_id"]
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")) \
        .select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def run(batches):
        t = tokenizer(shared.value)
        release()  # what reading the vocabulary took
        for b in batches:
            made, held = [], 0
            for i in range(b.num_rows):
                formatted, spans = render(list(zip(b.column(1)[i].as_py(), b.column(2)[i].as_py())))
                tokens = encode(t, formatted)
                made.append((formatted, tokens[:, 0], mask(tokens[:, 1:], spans), tokens[:, 1], tokens[:, 2]))
                held += len(formatted)
                if held >= BATCH or i + 1 == b.num_rows:
                    texts, *lists = zip(*made)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i + 1 - len(made), len(made)), pa.array(texts, pa.string()), *map(_lists, lists)],
                                                     names=["conv_id", "formatted", "ids", "loss", "token_starts", "token_ends"])
                    made, held = [], 0
        del t
        release()

    return whole.mapInArrow(run, f"conv_id {kind}, formatted string, ids array<int>, loss array<int>, token_starts array<int>, token_ends array<int>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what ``format_conversations`` wrote, read from its text, spans and mask alone."""
    kind = dict(formatted.dtypes)["conv_id"]
    read = formatted.select("conv_id", "formatted", "loss", "token_starts", "token_ends")

    def run(batches):
        for b in batches:
            out = []
            for k in range(b.num_rows):
                f, (loss, a, z) = b.column(1)[k].as_py(), (b.column(i)[k].values.to_numpy() for i in (2, 3, 4))
                turns = parse(f)
                under = unescape(masked_text(f, np.column_stack([a, z]), loss))
                out.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), _sha(under), len(f), len(loss), int(loss.sum())))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=["conv_id", *names])
        release()

    return read.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
