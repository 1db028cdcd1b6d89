"""Command templates with ``$inN`` and ``$outN`` references, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"\$(?:in|out)\d+"


def references(command: Column, kind: str) -> Column:
    """Distinct numbers of the references of a kind (in or out), in ascending order."""
    found = F.regexp_extract_all(command, F.lit(rf"\$({kind})(\d+)"), F.lit(2))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def valid(command: Column, inputs: Column, outputs: Column) -> Column:
    """Whether all references are among the declared inputs and outputs, counted from 1."""
    outside = lambda kind, n: F.exists(references(command, kind), lambda x: (x < 1) | (x > n))
    return ~(outside("in", inputs) | outside("out", outputs))


def checked(command: Column, inputs: Column, outputs: Column) -> Column:
    return F.when(valid(command, inputs, outputs), command).otherwise(F.raise_error(F.concat(F.lit("references beyond the declared inputs or outputs: "), command)))


def substitute(command: Column, inputs: Column, outputs: Column) -> Column:
    """The command with each reference replaced by the path of that input or output (arrays of paths, counted from 1); a number
    beyond them is an error. What stands between references is kept, so that a path is never searched for references."""

    def path(reference: Column) -> Column:
        of_input = reference.startswith("$in")
        n = F.regexp_extract(reference, r"(\d+)$", 1).try_cast("int")
        paths = F.when(of_input, inputs).otherwise(outputs)
        return F.when(n.between(1, F.size(paths)), F.get(paths, n - 1)).otherwise(F.raise_error(F.concat(F.lit("no input or output for "), reference)))

    between = F.split(command, REFERENCE, -1)
    paths = F.transform(F.regexp_extract_all(command, F.lit(f"({REFERENCE})"), F.lit(1)), path)
    return F.array_join(F.zip_with(between, paths, lambda text, p: F.concat(text, F.coalesce(p, F.lit("")))), "")


def _split_at(text: Column) -> Column:
    """Where the arguments begin (from 1), or null: behind a closing quote if the line begins with one, else at the first space."""
    quote = F.when(F.locate('"', text, 2) > 1, F.locate('"', text, 2) + 1)
    space = F.when(F.instr(text, " ") > 1, F.instr(text, " "))
    at = F.when(text.startswith('"') & (F.char_length(text) > 2), quote).otherwise(space)
    return F.when(at <= F.char_length(text), at)


def program(command: Column) -> Column:
    """Program of a command line: up to the first space, or what is quoted, quotes included; all of it if the quote is not closed."""
    text = F.btrim(command, F.lit(" \t\r\n"))
    at = _split_at(text)
    return F.when(at.isNull(), text).otherwise(F.rtrim(F.substring(text, F.lit(1), at - 1)))


def arguments(command: Column) -> Column:
    text = F.btrim(command, F.lit(" \t\r\n"))
    at = _split_at(text)
    return F.when(at.isNull(), F.lit("")).otherwise(F.btrim(F.substring(text, at, F.char_length(text)), F.lit(" \t\r\n")))
