"""Questions that help a reviewer, or a model, decide whether a finding is real."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import literal_map

VERDICTS = ("true_positive", "false_positive", "needs_more_context")


@dataclass(frozen=True)
class Guide:
    what: str
    real: tuple[str, ...]
    harmless: tuple[str, ...]
    ask: tuple[str, ...]


GUIDES = {
    "sql_injection": Guide(
        "A statement for a database is put together from text that others control.",
        ("a value is joined into the statement by +, formatting or interpolation", "the value can be traced to a request, a file or an argument"),
        ("values are bound as parameters", "every part of the statement is a constant or comes from a fixed list"),
        ("Where does each joined value come from?", "Is it bound, cast to a number or checked against a list before?"),
    ),
    "xss": Guide(
        "Text that others control reaches a page without being escaped.",
        ("the text goes into markup through a raw interface", "escaping is switched off around it"),
        ("the text is a constant", "it was cleaned by a list of allowed elements before"),
        ("Who can write the text?", "Which code escapes it on the way to the page?"),
    ),
    "command_injection": Guide(
        "Text that others control becomes part of a command or of code that is run.",
        ("a shell reads the joined line", "text is run as code"),
        ("arguments are a list and no shell is used", "the command is a constant"),
        ("Does a shell or an interpreter read the value?", "Can the value hold signs that these treat specially?"),
    ),
    "path_traversal": Guide(
        "A name that others control decides which file is read or written.",
        ("a folder and a given name are joined without a check", "the name may hold .. or be absolute"),
        ("the resolved path is checked against the folder", "the name comes from a fixed list"),
        ("Is the path resolved before it is checked?", "Who chooses the name?"),
    ),
    "insecure_function": Guide(
        "A function is used whose use in this place is known to be unsafe.",
        ("it protects something: passwords, tokens, signatures, foreign data", "there is no check around it"),
        ("it serves no protection, as in checksums or samples", "its input is made by the program itself"),
        ("What relies on the result?", "Where does the input come from?"),
    ),
    "insecure_pattern": Guide(
        "A setting or a way of writing weakens a protection.",
        ("it holds for what is deployed", "nothing else gives the protection back"),
        ("it stands in tests or in tools for developers", "another layer does what it switches off"),
        ("Where does this code run?", "Which other layer protects it?"),
    ),
    "secret": Guide(
        "A key or a password stands in the text.",
        ("it has the form of a real key", "it is used to sign in somewhere"),
        ("it is an example, a placeholder or a value of a test", "it is public by design"),
        ("Is the value still valid?", "Who can read this file?"),
    ),
}


def finding_types() -> list[str]:
    return sorted(GUIDES)


def _guide(g: Guide) -> str:
    part = lambda title, lines: f"{title}\n" + "\n".join(f"- {x}" for x in lines)
    return "\n\n".join((g.what, part("Signs that it is real", g.real), part("Signs that it is harmless", g.harmless), part("Questions", g.ask)))


def prompt(code: Column) -> Column:
    """The text to hand over for each finding, with its code; null where there is no guide for its type."""
    guide = F.try_element_at(literal_map({k: _guide(g) for k, g in GUIDES.items()}), F.col("finding_type"))
    head = F.concat(F.lit("Finding: "), "finding_type", F.lit(", "), "severity", F.lit(", line "), F.col("line_number").cast("string"), F.coalesce(F.concat(F.lit(", rule "), "pattern_name"), F.lit("")), F.lit("\n"), "message")
    ask = f"Answer with a verdict ({', '.join(VERDICTS)}), how sure you are (high, medium, low), the reason in up to three sentences, and the code that decides it."
    return F.concat(head, F.lit("\n\n"), guide, F.lit("\n\nCode\n"), F.coalesce(code, F.coalesce("matched_text", F.lit(""))), F.lit("\n\n" + ask))


def with_prompt(findings: DataFrame, code: Column | None = None) -> DataFrame:
    return findings.withColumn("triage_prompt", prompt(F.lit(None).cast("string") if code is None else code))
