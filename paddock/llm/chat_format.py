"""Chat formatting by token-level assembly.

Each turn becomes ``<|im_start|>role\\ncontent<|im_end|>\\n``. The control marks
are reserved token ids, spliced between separately encoded segments, so no
text can produce them; the loss mask covers the content segment of assistant
turns and comes from prefix sums of the segment lengths. Control strings
inside a role or a text are escaped (``<`` + backslashes + ``|`` gets one more
backslash) and restored on reading back.

Defined results: a null role or text is empty; turns are ordered by turn, role
and tokens (null turns first), repeated rows are separate turns; a null
conv_id is a conversation of its own; very long texts are encoded in chunks;
input columns with other names are ignored; an empty table gives an empty
result. A conversation's digest is sequential by definition: its turns are
sorted by Spark (spilling) and streamed through the hash state, so a
conversation of any length needs constant memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.text import list_array, map_batches

# GPT-2's split pattern, as the vocabulary files document it (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class ChatTemplate:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    start_id: int = 50257
    end_id: int = 50258
    start_text: str = "<|im_start|>"
    end_text: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    chunk_chars: int = 1 << 16


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line: line breaks and backslashes are written as escapes."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a rank file, once per worker."""
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, template: ChatTemplate) -> list[int]:
    enc, size = encoder(template.vocabulary), template.chunk_chars
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [t for at in range(0, len(text), size) for t in enc.encode_ordinary(text[at:at + size])]


def assemble(turns: list[tuple[str, str]], template: ChatTemplate) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and loss mask of some turns, flat, and the token count of each turn."""
    tail = encode("\n", template)
    segments: list[list[int]] = []
    learned: list[bool] = []
    for role, text in turns:
        segments += [[template.start_id], encode(escape_role(role) + "\n", template),
                     encode(escape(text), template), [template.end_id], tail]
        learned += [False, False, role in template.loss_roles, False, False]
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    tokens = np.fromiter((t for s in segments for t in s), dtype=np.int32, count=int(sizes.sum()))
    ends = np.cumsum(sizes)
    chosen = np.array(learned, dtype=bool)
    steps = np.zeros(len(tokens) + 1, dtype=np.int32)
    np.add.at(steps, (ends - sizes)[chosen], 1)
    np.add.at(steps, ends[chosen], -1)
    return tokens, np.cumsum(steps[:-1]).astype(np.int8), sizes.reshape(-1, 5).sum(axis=1)


def format_turns(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per turn: conv_id, turn, role, ``tokens`` and their ``loss`` mask (a narrow map)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                turns = [(r or "", t or "") for r, t in zip(part.column("role").to_pylist(),
                                                            part.column("text").to_pylist(), strict=True)]
                tokens, mask, sizes = assemble(turns, template)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), pa.array([r for r, _ in turns], pa.string()),
                     list_array(pa.array(tokens), sizes), list_array(pa.array(mask), sizes)],
                    ["conv_id", "turn", "role", "tokens", "loss"])

    narrow = conversations.select(F.col("conv_id").cast("long").alias("conv_id"),
                                  F.col("turn").cast("long").alias("turn"),
                                  F.col("role").cast("string").alias("role"),
                                  F.col("text").cast("string").alias("text"))
    return map_batches(narrow, run, "conv_id long, turn long, role string, tokens array<int>, loss array<tinyint>")


def parse(tokens: np.ndarray, mask: np.ndarray, template: ChatTemplate) -> tuple[str, str, str, int]:
    """Role, text, text under the loss mask and formatted length, from one turn's tokens."""
    enc = encoder(template.vocabulary)
    end = int(np.flatnonzero(tokens == template.end_id)[0])
    header, _, body = enc.decode_bytes(tokens[1:end].tolist()).decode("utf-8").partition("\n")
    learned = enc.decode_bytes(tokens[mask > 0].tolist()).decode("utf-8")
    tail = enc.decode_bytes(tokens[end + 1:].tolist()).decode("utf-8")
    chars = len(template.start_text) + len(header) + 1 + len(body) + len(template.end_text) + len(tail)
    return unescape_role(header), unescape(body), unescape(learned), chars


def read_back(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests of each conversation, decoded from the tokens of ``format_turns``."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens",
             "n_loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def row(key, s) -> tuple:
            return (key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5], s[6])

        for batch in batches:
            done = []
            flat = batch.column("tokens").flatten().to_numpy(zero_copy_only=False)
            loss = batch.column("loss").flatten().to_numpy(zero_copy_only=False)
            offsets = batch.column("tokens").offsets.to_numpy()
            offsets = offsets - offsets[0]
            for i, key in enumerate(batch.column("conv_id").to_pylist()):
                if state is None or key != current:
                    if state is not None:
                        done.append(row(current, state))
                    current, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                a, b = offsets[i], offsets[i + 1]
                role, text, learned, chars = parse(flat[a:b], loss[a:b], template)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += chars
                state[5] += int(b - a)
                state[6] += int(loss[a:b].sum())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], names)
        if state is not None:
            last = row(current, state)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in last], names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tokens")
    return map_batches(
        ordered.select("conv_id", "tokens", "loss"), run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_tokens long, n_loss_tokens long")
