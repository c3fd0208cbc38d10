"""Schemas of the tables that stages exchange, as Spark DDL and StructTypes.

``_pos`` is the place of a row in its file; readers add it where a file's order decides
which of two rows wins.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

WORD = "struct<word: string, start: double, end: double, probability: double>"
SPAN = "struct<start: int, end: int, type: string, text: string, score: double, source: string>"
ENTITY = "struct<pii_type: string, text: string, start_char: int, end_char: int>"
INTERVAL = "struct<start: double, end: double>"

_DDL = {
    "MANIFEST": (
        "item_id string, utt_id string, split string, source string, audio_path string, sampling_rate int, duration_sec double, transcript string, speaker_id string, session_id string"
    ),
    "SEGMENTS": (
        "segment_id string, source_item_id string, audio_path string, text string, language string, language_counts struct<zh_chars: int, en_chars: int>, "
        f"detected_file_language string, detected_file_language_probability double, start double, end double, words array<{WORD}>, decode_mode string, decode_language string, source string"
    ),
    "SPAN_ROWS": f"segment_id string, audio_path string, text string, spans array<{SPAN}>",
    "AUDIT": (
        "source_audio string, masked_audio string, segments_count int, first_segment_id string, last_segment_id string, sample_segment_ids array<string>, masked_span_count int, unmapped_spans int, "
        "segments_with_words int, segments_without_words int, word_aligned_spans int, ratio_aligned_spans int, intervals_count_raw int, intervals_count_merged int, masked_duration_sec double, "
        f"time_intervals_sec array<{INTERVAL}>, method string, mask_mode string, mask_engine string, mask_error string"
    ),
    "GOLD": f"record_id string, audio_id string, language string, split string, transcript string, entities array<{ENTITY}>",
    "PREDICTIONS": f"record_id string, transcript string, spans array<{SPAN}>",
    "BIO_SENTENCES": "item_id string, lang string, split string, tokens array<string>, gold_tags array<int>, gold_tag_names array<string>",
    "SUBWORD_RECORDS": "record_id string, language string, text string, input_ids array<int>, attention_mask array<int>, labels array<int>",
    "CONVERSATION_SCORES": (
        "split string, item_id string, utt_id string, duration_sec double, lang_bucket string, wer double, cer double, ref_word_tokens int, hyp_word_tokens int, ref_chars int, hyp_chars int"
    ),
    "UTTERANCE_SCORES": (
        "model string, seg_id string, session string, language string, start_sec double, end_sec double, ref string, ref_display string, ref_norm string, pred_raw string, pred_norm string, "
        "audio_dur_sec double, inference_sec double, wer double, cer double, mer double, wil double, wip double, hits int, substitutions int, deletions int, insertions int"
    ),
    "CHUNKS": "record_id string, chunk_id string, split string, language string, audio_path string, start_sec double, end_sec double, transcript string",
    # Transcripts of audio clips, for the replaying recogniser.
    "TRANSCRIPTION": f"audio_path string, language string, text string, start double, end double, words array<{WORD}>",
}


@cache
def __getattr__(name: str) -> StructType:
    """Schemas are parsed when they are asked for, as that takes a session."""
    if name not in _DDL:
        raise AttributeError(name)
    return StructType.fromDDL(_DDL[name])
