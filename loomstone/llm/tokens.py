"""Token counts by offset-mapped attribution: whole documents are encoded once, tokens counted by section.

Tokens of a byte-level vocabulary cover consecutive bytes, so ids give spans by a running sum of their
lengths. Sections are spans too; an interval join by binary search over both, in order, gives each token to
the sections it touches. A token that crosses boundaries goes by an explicit rule:

- "start": to the section of its first byte;
- "most": to the section with most of its bytes, the first of equals;
- "share": to each section in proportion to its bytes (counts are then fractions that add up to whole tokens).
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, read, slices
from .registry import query

RULES = ("start", "most", "share")
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The vocabulary's encoder, and the bytes of each id."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for data, i in ranks.items():
        sizes[i] = len(data)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def spans(text: str, path: str) -> np.ndarray:
    """Where each token of the text ends, in bytes; tokens follow one another without gaps."""
    encoder, sizes = encoding(path)
    return np.cumsum(sizes[encoder.encode_to_numpy(text).astype(np.int64)])


def attributed(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many cross a boundary. Both arrays hold ends of consecutive spans from 0."""
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crossing = np.nonzero(first != last)[0]
    if rule == "start":
        return np.bincount(first, minlength=len(section_ends)).astype(float), len(crossing)
    counts = np.bincount(np.delete(first, crossing), minlength=len(section_ends)).astype(float)
    begins = np.concatenate([[0], section_ends[:-1]])
    for t in crossing.tolist():
        touched = np.arange(first[t], last[t] + 1)
        inside = np.minimum(section_ends[touched], token_ends[t]) - np.maximum(begins[touched], starts[t])
        if rule == "most":
            counts[touched[inside.argmax()]] += 1
        else:
            counts[touched] += inside / (token_ends[t] - starts[t])
    return counts, len(crossing)


def line_ends(data: bytes) -> np.ndarray:
    """Ends of the sections of a text: lines, each with the line feed that ends it. No text has one empty section."""
    at = np.nonzero(np.frombuffer(data, np.uint8) == 10)[0] + 1
    return at if len(at) and at[-1] == len(data) else np.concatenate([at, [len(data)]])


def counted(rows: DataFrame, fields: list[str], path: str, rule: str = "start", by_line: bool = True, key: str = "doc_id") -> DataFrame:
    """doc_id, field, section, first_byte, end_byte, tokens, crossing: a row a section of each document.

    The fields, null as empty, are joined without anything between and encoded as one text. Sections are the
    lines of each field, or the whole fields. first_byte and end_byte are places in the field. `crossing` is the
    number of the document's tokens that touch more than one section, the same in each of its rows. Documents
    without any text have a row a field, with no tokens. Repeated rows are counted each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    schema = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("section", pa.int32()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("tokens", pa.float64()), ("crossing", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, fields[-1]):
                out = []
                texts = [[x or "" for x in part.column(i + 1).to_pylist()] for i in range(len(fields))]
                for doc, *values in zip(part.column(0).to_pylist(), *texts):
                    at, ends, names = 0, [], []
                    for name, value in zip(fields, values):
                        data = value.encode()
                        own = line_ends(data) if by_line else np.array([len(data)])
                        names += [(name, k, a, b) for k, (a, b) in enumerate(zip([0, *own[:-1].tolist()], own.tolist()))]
                        ends.append(own + at)
                        at += len(data)
                    counts, crossing = attributed(spans("".join(values), path), np.concatenate(ends), rule)
                    out += [(doc, *n, c, crossing) for n, c in zip(names, counts.tolist())]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    columns = [F.col(key).cast("long").alias("doc_id"), *(F.col(f"`{f}`").cast("string").alias(f) for f in fields)]
    return rows.select(*columns).mapInArrow(lean(run), "doc_id long, field string, section int, first_byte long, end_byte long, tokens double, crossing long")


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    """Tokens of every line of all documents, each document encoded whole; a token belongs to the line of its first byte."""
    import public_tokenizers

    found = counted(read(spark, sf_dir, "documents"), ["text"], public_tokenizers.path(VOCABULARY))
    return found.select("doc_id", "section", "first_byte", "end_byte", F.col("tokens").cast("long").alias("n_tokens"), "crossing")
