from .keys import key60, md5_key
from .scoring import (
    lexical_coherence,
    lexical_coherence_scores,
    shared_words,
    log_softmax_at,
    logits_from_score,
    predict_label,
    softmax,
    softmax_positive,
)
from .sentences import (
    canonical_positions,
    join_sentences,
    pick_sentences,
    sentence_count,
    split_sentences,
    word_sets,
)

__all__ = [
    "canonical_positions", "join_sentences", "key60", "lexical_coherence", "lexical_coherence_scores", "shared_words", "log_softmax_at",
    "logits_from_score", "md5_key", "pick_sentences", "predict_label", "sentence_count",
    "softmax", "softmax_positive", "split_sentences", "word_sets",
]
