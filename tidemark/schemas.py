"""Canonical tables. Times are BIGINT microseconds of recording time; `by` columns (asset_id) partition everything."""

from __future__ import annotations

SECOND = 1_000_000

INTERVAL = "asset_id long, start_us long, end_us long"
TIMELINE_EVENT = "asset_id long, event_id long, event_type string, start_us long, end_us long, speaker long, confidence double"
WORD = "text string, start double, end double"
BLOCK = "source_start double, source_end double, edit_start double, edit_end double, speed_ratio double, is_manual_override boolean, label string"
EFFECT = "effect_type string, type string, target string, source_start double, source_end double, is_false_positive boolean"
TRUTH = f"source_duration double, edit_duration double, human_edit_duration double, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>, effects array<struct<{EFFECT.replace(' ', ':').replace(',:', ',')}>>, retained_intervals array<struct<source_start:double,source_end:double>>"
