"""Token counts by the whole-token shortcut.

Offline, once per process, ``vocab.Encoder`` proves which vocabulary strings are one
pre-token and encode alone as one token.  A text's pre-tokens that are such strings
count one each without a merge; only the rest goes through the merges.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscribe.llm import vocab
from veilscribe.llm.store import free


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = vocab.DEFAULT_VOCABULARY, limit: int = 512) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_tokens, over_limit, n_direct.

    The counts are those of the tokenizers library without added special tokens.  A null
    text is an empty one and has 0 of each; a null id stays null; repeated rows stay
    repeated; other columns of ``docs`` are ignored, whatever their names, and a result
    named like the id has an underscore after it.  One narrow
    pass: nothing is shuffled, and texts of any length are counted whole.
    n_direct is how many tokens the shortcut gave.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    names = [id_col, *free([id_col], "n_bytes", "n_tokens", "over_limit", "n_direct")]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, (kind.simpleString(), "long", "long", "boolean", "long"), strict=True))

    def count(batches):
        encoder = vocab.encoder(vocabulary)
        for batch in batches:
            found = []
            for (text,) in vocab.rows(batch, "text"):
                text = text or ""
                found.append((len(text.encode()), *encoder.count(text)))
            n_bytes, n_tokens, direct = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(direct, pa.int64())],
                names,
            )

    return source.mapInArrow(count, schema)
