"""Explicit types of the archive's twelve tables; reads never infer."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, LongType, MapType, StringType, StructField, StructType

_KINDS = {"BIGINT": LongType(), "INT": IntegerType(), "STRING": StringType(), "MAP<STRING,STRING>": MapType(StringType(), StringType())}


def _of(ddl: str) -> StructType:
    """From 'name KIND [NOT NULL], ...', without a session."""
    fields = [f.split(maxsplit=2) for f in ddl.split(", ")]
    return StructType([StructField(name, _KINDS[kind], not rest) for name, kind, *rest in fields])


ENTRIES = _of(
    "itemid BIGINT NOT NULL, anum INT NOT NULL, ditemid BIGINT NOT NULL, eventtime STRING NOT NULL, logtime STRING, subject STRING, "
    "body STRING NOT NULL, security STRING NOT NULL, allowmask BIGINT, mood STRING, moodid INT, music STRING, location STRING, "
    "picture_keyword STRING, props MAP<STRING,STRING>, fetched_at STRING NOT NULL"
)
ENTRY_TAGS = _of("itemid BIGINT NOT NULL, tag STRING NOT NULL")
MOODS = _of("moodid INT NOT NULL, name STRING NOT NULL, parent INT")
USERS = _of("posterid BIGINT NOT NULL, username STRING NOT NULL")
COMMENTS = _of("id BIGINT NOT NULL, jitemid BIGINT NOT NULL, parentid BIGINT, posterid BIGINT, subject STRING, body STRING, date STRING, state STRING NOT NULL, fetched_at STRING NOT NULL")
SYNC_STATE = _of("key STRING NOT NULL, value STRING NOT NULL")
ASSETS = _of("hash STRING NOT NULL, mime STRING NOT NULL, byte_len BIGINT NOT NULL, width INT, height INT, status STRING NOT NULL, local_path STRING, fetched_at STRING NOT NULL")
ASSET_REFS = _of("id BIGINT NOT NULL, hash STRING, source_url STRING NOT NULL, host STRING, context STRING NOT NULL, context_id BIGINT NOT NULL, alt_text STRING, http_status INT, error STRING, fetched_at STRING")
USERPICS = _of("picid BIGINT NOT NULL, userid BIGINT NOT NULL, url STRING NOT NULL, keyword STRING, hash STRING, fetched_at STRING")
ENTRY_USERPICS = _of("ditemid BIGINT NOT NULL, picid BIGINT NOT NULL")
COMMENT_USERPICS = _of("comment_id BIGINT NOT NULL, picid BIGINT NOT NULL")
ENTRY_EMBEDS = _of("ditemid BIGINT NOT NULL, idx INT NOT NULL, url STRING NOT NULL, thumb_hash STRING, fetched_at STRING")

TABLES = {
    "entries": (ENTRIES, ["itemid"]), "entry_tags": (ENTRY_TAGS, ["itemid", "tag"]), "moods": (MOODS, ["moodid"]), "users": (USERS, ["posterid"]),
    "comments": (COMMENTS, ["id"]), "sync_state": (SYNC_STATE, ["key"]), "assets": (ASSETS, ["hash"]), "asset_refs": (ASSET_REFS, ["source_url", "context", "context_id"]),
    "userpics": (USERPICS, ["picid"]), "entry_userpics": (ENTRY_USERPICS, ["ditemid"]), "comment_userpics": (COMMENT_USERPICS, ["comment_id"]), "entry_embeds": (ENTRY_EMBEDS, ["ditemid", "idx"]),
}
