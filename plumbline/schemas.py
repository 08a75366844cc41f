"""Explicit schemas of the tables the engine reads and writes."""

from __future__ import annotations

#: Nested scrape records.
ADS = (
    "pageName string, adArchiveId string, adArchiveID string, startDate bigint, isActive boolean, "
    "snapshot struct<displayFormat: string, images: array<struct<originalImageUrl: string, resizedImageUrl: string>>, "
    "cards: array<struct<originalImageUrl: string, resizedImageUrl: string>>>"
)
POSTS = (
    "ownerUsername string, shortCode string, id string, type string, timestamp string, displayUrl string, "
    "childPosts array<struct<type: string, displayUrl: string>>"
)
MANIFEST = "brand string, ad_id string, file string, url string, start_date bigint, display_format string, is_active boolean, sha1 string"
EMBEDDING = "id string, vec array<float>"
#: Sparse union of what the instruments record beside an item.
META = (
    "struct<source_id: string, brand: string, certification: string, dimension: string, corruption: string, severity: int, "
    "strength: double, prompt_idx: int, seed: bigint, adapter_scale: double>"
)
INDEX = f"item_id string, instrument string, path string, label string, meta {META}"
SCORES = "judge string, item_id string, score double"
RUBRIC = (
    "item_id string, palette int, composition int, typography int, styling int, mood int, overall_consistency int, reason string, "
    "error string, _usage struct<`in`: bigint, `out`: bigint, cached: bigint>"
)
FEATURES = "item_id string, label string, features struct<palette_de: double, wordmark: double, sat_mean: double, colorfulness: double, text_frac: double>"
BON_MANIFEST = "file string, prompt_idx int, prompt string, candidate int, seed bigint, steps int, guidance double, size int, model string"
JUDGE_PARAMS = "judge string, centroid array<double>, platt_a double, platt_b double"
OCR = "item_id string, words array<struct<text: string, conf: double, box: array<int>>>"
MASKED = (
    "masked_file string, source_id string, brand string, label string, method string, mask_frac double, "
    "regions array<struct<box: array<int>, provenance: string, text: string, conf: double>>, repair_class string, generator_version string"
)
EVAL_SCORES = "judge string, stage string, kind string, prompt_idx int, cand int, score double"
