"""What all reports share: rules, levels, file names."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import functions as F

LEVELS = {"critical": "error", "high": "error", "medium": "warning"}


def rule_id(id_column="id", metadata="metadata"):
    """ruleId of the metadata, else the first two parts of the id, with plain characters only."""
    given = F.get_json_object(metadata, "$.ruleId")
    return F.substring(F.regexp_replace(F.coalesce(given, F.substring_index(id_column, ":", 2)), r"[^A-Za-z0-9._/-]", "-"), 1, 200)


def slug(repo_id: str) -> str:
    """A file name for a repository: its id where that is plain and short, else with a hash of it."""
    plain = re.sub(r"[^A-Za-z0-9._-]+", "-", repo_id)[:100]
    return plain if plain == repo_id else f"{plain}-{zlib.crc32(repo_id.encode()):08x}"
