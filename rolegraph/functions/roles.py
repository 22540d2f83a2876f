"""Names of roles as they are shown, and the keys behind typed names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys and shown names of the known roles.
NAMES = {
    "main": "main artist", "album": "album artist", "composer": "composer", "conductor": "conductor", "remixer": "remixer", "lyricist": "lyricist",
    "performer": "performer", "producer": "producer", "engineer": "engineer", "featured": "featured",
}


def role_label(role: Column) -> Column:
    """The shown name; a key that is not known stands for itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), role), role)
