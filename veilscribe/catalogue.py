"""Every query of the library outside ``llm``, with its SQL."""

from __future__ import annotations

from veilscribe.queries import formats, quality, scores, texts, timing

QUERIES: dict = {**texts.QUERIES, **timing.QUERIES, **scores.QUERIES, **quality.QUERIES, **formats.QUERIES}
SQL: dict = {**texts.SQL, **timing.SQL, **scores.SQL, **quality.SQL, **formats.SQL}
