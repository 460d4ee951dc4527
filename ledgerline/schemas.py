"""Schemas of the entities, and their enumerations."""

from __future__ import annotations

SOURCE_TRACKS = "position bigint, id string, title string, artist string, all_artists array<string>, album string, duration_ms bigint, code string"
SOURCE_ALBUMS = "position bigint, id string, title string, artist string, code string, release_year string, total_tracks int"
SOURCE_PLAYLISTS = "id string, name string, tracks_count int, snapshot_id string"
PLAYLIST_TRACKS = "playlist_id string, position bigint, track_id string"
TARGET_TRACKS = "id bigint, title string, artist string, album string, duration_ms bigint, code string"
TARGET_ALBUMS = "id string, title string, artist string, release_year string, tracks_count int, code string"
TARGET_PLAYLISTS = "id string, name string, tracks_count int"
FAVORITES = "position bigint, id bigint, code string"
SUGGESTION = "struct<target_id: bigint, title: string, artist: string, album: string, score: double, title_score: double, artist_score: double, duration_diff_sec: double>"
LEDGER = "user_id string, source_id string, target_id string, sync_type string, synced_at timestamp"
UNMATCHED = "user_id string, source_id string, title string, artist string, album string, sync_type string, suggestions_json string, status string, resolved_target_id string, created_at timestamp, updated_at timestamp"
SYNCED_PLAYLISTS = "user_id string, playlist_id string, snapshot_id string, track_count int, synced_at timestamp"
RUNS = "id bigint, user_id string, started_at timestamp, completed_at timestamp, status string, sync_type string, dry_run boolean, tracks_matched int, tracks_not_matched int, code_matches int, fuzzy_matches int, report_json string"
ACTIVE_TASKS = "id string, user_id string, run_id bigint, sync_type string, status string, dry_run boolean, progress_json string, error string, report_json string, chunk_state_json string, created_at timestamp, updated_at timestamp"
CHUNK_STATE = "struct<offset: bigint, totalItems: bigint, processedInChunk: bigint, hasMore: boolean>"
OAUTH_STATES = "id string, redirect_uri string, expires_at timestamp"
SCHEMA_VERSIONS = "version int, name string, applied_at timestamp"

LEDGER_KEY = ["user_id", "source_id", "sync_type"]
PLAYLIST_KEY = ["user_id", "playlist_id"]

RUN_STATUSES = ("running", "completed", "failed", "interrupted")
TASK_STATUSES = ("pending", "starting", "running", "chunk_complete", "completed", "failed", "cancelled", "interrupted")
LIVE_TASK_STATUSES = ("starting", "running", "chunk_complete")
SYNC_TYPES = ("favorites", "albums", "playlists")
MATCH_TYPES = ("code", "fuzzy", "fuzzy_album", "fuzzy_clean", "fuzzy_primary", "fuzzy_artist", "fuzzy_title")
UNMATCHED_STATUSES = ("pending", "resolved", "dismissed")
