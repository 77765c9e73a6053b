"""EP8, EP9, SRC16, SRC17, SNK10, SNK11: the worlds and assets that a user interface shows and edits.

Both tables are small and edited one row at a time by one driver; they are Parquet snapshots like the rest, so an edit
is there whole or not at all.
"""

from __future__ import annotations

import datetime as dt
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import status, text
from ..operators import worlds as rows
from ..sources.stored import Snapshots

WORLDS = "world_uuid string, title string, description string, background_asset_id string, font_asset_id string, last_used_at timestamp, modified_at timestamp"
ASSETS = "asset_id string, kind string, name string, original_filename string, stored_filename string, content_type string, created_at timestamp, content binary"
#: The selections of a world that made none.
DEFAULTS = {"image": "default-image-world", "font": "default-font-inter"}
_SELECTED = {"image": "background_asset_id", "font": "font_asset_id"}


class LibraryError(ValueError):
    """A request that breaks a rule; its text is the rule's code."""


def font_full_name(content: bytes) -> str:
    """TOP6: the full name (record 4) in a font's name table, the Windows record first."""
    try:
        count = struct.unpack_from(">H", content, 4)[0]
        tables = {content[12 + 16 * i : 16 + 16 * i]: struct.unpack_from(">II", content, 20 + 16 * i) for i in range(count)}
        start, _ = tables[b"name"]
        _, records, strings = struct.unpack_from(">HHH", content, start)
        found = []
        for i in range(records):
            platform, _, _, name, length, offset = struct.unpack_from(">HHHHHH", content, start + 6 + 12 * i)
            if name == 4:
                data = content[start + strings + offset : start + strings + offset + length]
                found.append((platform != 3, i, data.decode("utf-16-be" if platform in (0, 3) else "mac-roman")))
        names = [" ".join(n.split()) for _, _, n in sorted(found) if n.strip()]
        return names[0]
    except (struct.error, KeyError, IndexError, UnicodeDecodeError) as e:
        raise LibraryError("FONT_NAME_UNREADABLE") from e


@dataclass
class Library:
    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        self._worlds, self._assets = Snapshots(self.spark, f"{self.folder}/worlds"), Snapshots(self.spark, f"{self.folder}/assets")

    def worlds(self) -> DataFrame:
        """SRC17, TOP4: all worlds, newest use first."""
        return rows.hub_order(self._worlds.read(WORLDS), "last_used_at", "modified_at", "title")

    def assets(self) -> DataFrame:
        """SRC16, SET5: built-in and user assets, without contents; unsafe records are skipped."""
        built_in = self.spark.createDataFrame([(i, k) for k, i in DEFAULTS.items()], "asset_id string, kind string")
        users = self._assets.read(ASSETS).drop("content").filter(status.safe_record(F.col("kind"), F.col("asset_id"), F.col("stored_filename")))
        return rows.catalogue(built_in, users)

    def _exists(self, asset: str, kind: str) -> bool:
        return bool(self.assets().filter((F.col("asset_id") == asset) & (F.col("kind") == kind)).limit(1).count())

    def detail(self, world: str) -> dict:
        """PRJ16, JN10: one world; a selected asset that is gone shows as the default."""
        found = self._worlds.read(WORLDS).filter(F.col("world_uuid") == world).collect()
        if not found:
            raise LibraryError("WORLD_NOT_FOUND")
        out = found[0].asDict()
        for kind, column in _SELECTED.items():
            if not (out[column] and self._exists(out[column], kind)):
                out[column] = DEFAULTS[kind]
        return out

    def add(self, title: str) -> str:
        """A new world under a name that no other has."""
        key = str(uuid.uuid4())
        self._put(key, title, "", DEFAULTS["image"], DEFAULTS["font"])
        return key

    def save(self, world: str, display_name: str | None, description: str | None = None, background_asset_id: str | None = None, font_asset_id: str | None = None) -> dict:
        """SNK11: the checks in order, then the row."""
        if not self._worlds.read(WORLDS).filter(F.col("world_uuid") == world).limit(1).count():
            raise LibraryError("WORLD_NOT_FOUND")
        self._put(world, display_name, description or "", background_asset_id or DEFAULTS["image"], font_asset_id or DEFAULTS["font"])
        return self.detail(world)

    def _put(self, world: str, name: str | None, description: str, background: str, font: str) -> None:
        title = " ".join((name or "").split())
        if not title:
            raise LibraryError("WORLD_NAME_REQUIRED")
        held = self._worlds.read(WORLDS)
        key = text.name_key_folded(F.col("title")) == F.lit(title.casefold())
        if held.filter((F.col("world_uuid") != world) & key).limit(1).count():
            raise LibraryError("WORLD_NAME_DUPLICATE")
        if not self._exists(background, "image"):
            raise LibraryError("BACKGROUND_ASSET_NOT_FOUND")
        if not self._exists(font, "font"):
            raise LibraryError("FONT_ASSET_NOT_FOUND")
        row = self.spark.createDataFrame([(world, title, description, background, font, None, dt.datetime.now(dt.timezone.utc))], WORLDS)
        self._worlds.write(held.filter(F.col("world_uuid") != world).unionByName(row))

    def upload(self, kind: str, content: bytes, filename: str) -> str:
        """EP9, FLT14: an image or font after its checks; the new asset's id."""
        one = self.spark.createDataFrame([(bytearray(content), filename, kind)], "content binary, filename string, kind string")
        suffix = text.suffix(F.col("filename"))
        checked = one.select(status.asset_error(F.col("content"), suffix, F.col("kind")).alias("error"), suffix.alias("suffix"), text.display_filename(F.col("filename")).alias("name"), status.content_type(suffix).alias("type")).first()
        if checked.error:
            raise LibraryError(checked.error)
        name = checked.name if kind == "image" else font_full_name(content)
        key = str(uuid.uuid4())
        row = self.spark.createDataFrame([(key, kind, name, filename, key + checked.suffix, checked.type, dt.datetime.now(dt.timezone.utc), bytearray(content))], ASSETS)
        self._assets.write(self._assets.read(ASSETS).unionByName(row))
        return key

    def _user_asset(self, asset: str):
        found = self._assets.read(ASSETS).filter(F.col("asset_id") == asset).limit(1).collect()
        if not found:
            raise LibraryError("ASSET_NOT_FOUND")
        return found[0]

    def content(self, asset: str) -> tuple[bytes, str]:
        """(bytes, content type) of a user asset."""
        found = self._user_asset(asset)
        return bytes(found.content), found.content_type

    def delete_impact(self, asset: str) -> dict:
        """JN10: how many worlds would fall back."""
        kind = self._user_asset(asset).kind
        return {"asset_id": asset, "kind": kind, "affected_worlds": self._worlds.read(WORLDS).filter(F.col(_SELECTED[kind]) == asset).count()}

    def delete(self, asset: str) -> dict:
        """EP9, JN10: removes a user asset; worlds that selected it select the default."""
        if asset in DEFAULTS.values():
            raise LibraryError("DEFAULT_ASSET_DELETE_BLOCKED")
        impact = self.delete_impact(asset)
        kind = impact["kind"]
        self._worlds.write(rows.repaired(self._worlds.read(WORLDS), F.lit(asset), _SELECTED[kind], DEFAULTS[kind]))
        self._assets.write(self._assets.read(ASSETS).filter(F.col("asset_id") != asset))
        return impact
