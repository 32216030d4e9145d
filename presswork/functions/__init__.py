"""Column functions: everything here takes and returns ``Column``."""
from .images import best_image, image_score
from .quality import (
    candidate_quality, confidence, export_threshold, passes_gate, quality_score, quality_tier,
)
from .summary import extractive_summary, leading_text, ranked_sentences, sentence_score, sentences, trim_words
from .text import (
    article_id, clean_text, date_part, fingerprint, is_boilerplate, key_phrases, length_in_range,
    looks_like_date, normalize_text, published_ts, similarity_text, squeeze, summary_prompt,
    title_hash, title_or_link, word_count, words,
)
from .urls import join_url, resolve_image, resolve_link, url_host, url_path, url_scheme
