"""Column functions on paths. A null path gives null everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpline.model import EXCLUDED_DIRECTORIES, GENERIC_FOLDERS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def normalised(path: Column | str) -> Column:
    """Forward slashes only."""
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(normalised(path), r"([^/]*)/?$", 1)


def parent(path: Column | str) -> Column:
    """What stands before the last slash; ``/`` for a path at the root."""
    cut = F.regexp_replace(col(path), r"/[^/]*$", "")
    return F.when((cut == "") | (cut == col(path)), "/").otherwise(cut)


def extension(name: Column | str) -> Column:
    """The part after the last dot in lower case; empty without one and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(col(name), r"[^/]\.([^./]*)$", 1))


def segments(path: Column | str) -> Column:
    return F.filter(F.split(col(path), "/"), lambda s: s != "")


def ancestors(folder: Column | str) -> Column:
    """The folder and every folder above it, topmost first, without the root."""
    own = segments(folder)
    return F.transform(own, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(own, 1, i + 1), "/")))


def hidden(path: Column | str) -> Column:
    """Whether any segment begins with a dot."""
    return col(path).rlike(r"(^|/)\.")


def in_excluded_directory(path: Column | str, names: list[str] = EXCLUDED_DIRECTORIES) -> Column:
    """Whether a directory above the file has an excluded name (exact, case-sensitive)."""
    own = segments(path)
    return F.arrays_overlap(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), words(names))


def under_prefix(path: Column | str, prefixes: list[str], strict_boundary: bool = False) -> Column:
    """Whether the path begins with a prefix, in any case and with either slash. Without ``strict_boundary`` the prefix ``/Lib``
    also covers ``/Library``."""
    own = F.lower(normalised(path))
    found = F.lit(False)
    for p in (p.replace("\\", "/").lower() for p in prefixes):
        found = found | (own.startswith(p) if not strict_boundary else (own == p.rstrip("/")) | own.startswith(p.rstrip("/") + "/"))
    return F.when(col(path).isNotNull(), found)


def in_places(path: Column | str, fragments: list[str]) -> Column:
    """Whether a path holds one of the fragments (in lower case, with forward slashes), such as the folders that connectors or
    activity notes write; a null path holds none."""
    own, found = F.lower(normalised(F.coalesce(col(path), F.lit("")))), F.lit(False)
    for fragment in fragments:
        found = found | own.contains(fragment)
    return found


def excluded(path: Column | str, system: list[str], custom: list[str], recommended: bool = True) -> Column:
    """Excluded directory names and custom prefixes always count, system prefixes only with ``recommended``."""
    return in_excluded_directory(path) | under_prefix(path, custom + (system if recommended else []))


def origin(path: Column | str, downloads: list[str], synced: list[str], created: list[str]) -> Column:
    """downloaded, synced, created_here or unknown, by the first prefix list that holds the path."""
    own = normalised(path)

    def starts(prefixes: list[str]) -> Column:
        found = F.lit(False)
        for p in prefixes:
            found = found | own.startswith(p.replace("\\", "/"))
        return found

    return F.when(starts(downloads), "downloaded").when(starts(synced), "synced").when(starts(created), "created_here").otherwise("unknown")


def relative(path: Column | str) -> Column:
    """The path without a leading /Users/name/."""
    return F.regexp_replace(col(path), r"^/Users/[^/]+/(?=.)", "")


def meaningful_folder(path: Column | str) -> Column:
    """The deepest folder name that is not generic, after its parent's name if that is generic."""
    rel = relative(path)
    parts, generic = segments(rel), words(GENERIC_FOLDERS)
    last = F.array_max(F.filter(F.transform(parts, lambda p, i: F.when(~F.array_contains(generic, p), i)), lambda i: i.isNotNull()))
    name, before = F.get(parts, last), F.get(parts, last - 1)
    found = F.when((last > 0) & F.array_contains(generic, before), F.concat(before, F.lit("/"), name)).otherwise(name)
    return F.coalesce(found, F.get(parts, F.size(parts) - 1), rel)


def project(path: Column | str) -> Column:
    """The first folder name that is not generic; else the second or first name, else root."""
    parts, generic = segments(relative(path)), words(GENERIC_FOLDERS)
    return F.coalesce(F.get(F.filter(parts, lambda p: ~F.array_contains(generic, p)), F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(0)), F.lit("root"))
