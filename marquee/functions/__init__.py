from marquee.functions.scores import (
    clamp_weight, confidence, order_key, sanitize, score_genre_mode, score_item_mode,
)
from marquee.functions.text import (
    GENRE_VOCAB, extract_genres, normalize_title, requested_genres, split_genres,
    strip_text, text_state,
)

__all__ = [
    "GENRE_VOCAB", "clamp_weight", "confidence", "extract_genres", "normalize_title",
    "order_key", "requested_genres", "sanitize", "score_genre_mode", "score_item_mode",
    "split_genres", "strip_text", "text_state",
]
