"""Path and index functions as column expressions.

An artefact id is a path with ``/`` as delimiter; a final ``/`` marks a directory; each ``*`` is a dimension.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: suffixes of side files of this library
META_SUFFIX, HASH_SUFFIX = ".prov.json", ".hash"


def unix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalise_path(path: Column) -> Column:
    return F.trim(unix_path(path))


def is_directory(path: Column) -> Column:
    return path.endswith("/")


def is_metadata_file(path: Column) -> Column:
    return F.lower(path).endswith(META_SUFFIX)


def rank(path: Column) -> Column:
    """Number of dimensions."""
    return (F.char_length(path) - F.char_length(F.replace(path, F.lit("*"), F.lit("")))).cast("int")


def apply_index(path: Column, index: Column) -> Column:
    """Puts index parts in the place of successive ``*``; surplus parts are ignored, unfilled ``*`` stay."""

    def fill(done: Column, part: Column) -> Column:
        at = F.instr(F.element_at(done, 2), "*")
        rest = F.element_at(done, 2)
        filled = F.array(
            F.concat(F.element_at(done, 1), F.substr(rest, F.lit(1), at - 1), part),
            F.substr(rest, at + 1),
        )
        return F.when(at > 0, filled).otherwise(done)

    # what is filled in is set aside, so that a part holding ``*`` is not filled again
    return F.array_join(F.aggregate(index, F.array(F.lit("").cast("string"), path), fill), "")


def truncate_index(index: Column, to: int | Column) -> Column:
    """The first parts of an index; an index that is too short is an error."""
    to = F.lit(to) if isinstance(to, int) else to
    return F.when(F.size(index) >= to, F.slice(index, F.lit(1), to)).otherwise(F.raise_error(F.lit("the index has fewer parts than the rank asked for")))


def first_dot_stem(name: Column) -> Column:
    """Name up to its first dot; a name without one is an error."""
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", 1)).otherwise(F.raise_error(F.concat(F.lit("no extension in "), name)))


def side_stem(path: Column) -> Column:
    """Name stem of a side file: from the first ``*`` on, ``/`` becomes ``-`` and ``*`` becomes ``vector``."""
    bare = F.when(is_directory(path), F.substr(path, F.lit(1), F.char_length(path) - 1)).otherwise(path)
    at = F.instr(bare, "*")
    rest = F.replace(F.replace(F.substr(bare, at), F.lit("/"), F.lit("-")), F.lit("*"), F.lit("vector"))
    return F.when(at > 0, F.concat(F.substr(bare, F.lit(1), at - 1), rest)).otherwise(bare)


def metadata_file(path: Column) -> Column:
    return F.concat(side_stem(path), F.lit(META_SUFFIX))


def hash_file(path: Column) -> Column:
    return F.concat(side_stem(path), F.lit(HASH_SUFFIX))


def full_path(root: Column, artefact_id: Column) -> Column:
    """Root and id joined; the root must be absolute."""
    absolute = root.startswith("/") | root.contains("://")
    slash = F.when(root.endswith("/"), root).otherwise(F.concat(root, F.lit("/")))
    return F.when(absolute, F.concat(slash, artefact_id)).otherwise(F.raise_error(F.concat(F.lit("a relative root: "), root)))


def metadata_full_path(root: Column, artefact_id: Column) -> Column:
    """Where the metadata file of an id lies; the root must be absolute and end with ``/``."""
    name = metadata_file(artefact_id)
    return F.when(root.endswith("/"), full_path(root, name)).otherwise(F.raise_error(F.concat(F.lit("a root ends with /: "), root)))


def below(root: Column, relative: Column) -> Column:
    """A path under a root; an absolute one is an error."""
    return F.when(~(relative.startswith("/") | relative.contains("://")), full_path(root, relative)).otherwise(F.raise_error(F.concat(F.lit("an absolute path: "), relative)))


def format_number(document: Column) -> Column:
    """The format that a JSON document says it has, a whole number at its top; null if it says none."""
    said = F.get_json_object(document, "$.format")
    return F.when(F.regexp_like(said, F.lit("^-?[0-9]{1,9}$")), said).cast("int")


def _steps(path: Column) -> Column:
    """The steps of a path without empty ones, ``.`` and those that ``..`` takes back."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        below_root = (part == "..") & (F.size(done) == 0) & path.startswith("/")
        shorter = F.slice(done, F.lit(1), F.size(done) - 1)
        return F.when(part.isin("", ".") | below_root, done).when(up, shorter).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def _with_slash(joined: Column, path: Column) -> Column:
    return F.when(path.endswith("/") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def relative_path(base: Column, target: Column) -> Column:
    """Target relative to the folder that holds base; a final ``/`` is kept. Both are absolute, or both relative to one folder; a folder
    above that one which base begins with is left by its name only, so that is an error."""
    folder = F.regexp_extract(base, "^(.*/)?[^/]*$", 1)
    a, b = _steps(folder), _steps(target)
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), F.lit(0),
        lambda n, i: F.when((n == i - 1) & F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)) & F.try_element_at(a, i).isNotNull(), i).otherwise(n),
    )
    left = F.slice(a, same + 1, F.size(a))
    unknown = F.exists(left, lambda x: x == "..")
    out = F.array_join(F.concat(F.transform(left, lambda _: F.lit("..")), F.slice(b, same + 1, F.greatest(F.size(b), F.lit(1)))), "/")
    out = _with_slash(F.when(out == "", F.lit(".")).otherwise(out), target)
    mixed = base.startswith("/") != target.startswith("/")
    return F.when(unknown | mixed, F.raise_error(F.concat(F.lit("no way from "), base, F.lit(" to "), target))).otherwise(out)


def resolved_id(metadata_path: Column, relative: Column) -> Column:
    """Id of a path that stands in a metadata file, relative to that file's folder."""
    whole = F.when(relative.startswith("/"), relative).otherwise(F.concat(F.regexp_extract(metadata_path, "^(.*/)?[^/]*$", 1), relative))
    out = F.concat(F.when(whole.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(_steps(whole), "/"))
    return _with_slash(F.when(out == "", F.lit(".")).otherwise(out), relative)
