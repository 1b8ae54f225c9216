"""Text scanners: a table of documents in, a table of findings out.

Each scanner is one narrow stage. Rules that the sensitivity, the category or the language of every row rules out
are pruned on the driver, before there is a plan; the rest become one array of literal expressions per line, of which
the hits are kept. A document is exploded to lines once, whatever the number of rules, and lines without any hit
leave before anything is shuffled. Offsets come from the pieces between matches, counted in code points.

Documents have ``doc_id`` and ``text``, and may have ``file_path`` and ``language``.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import guards as G
from sieveline.functions import rules as R
from sieveline.functions import text as X
from sieveline.functions.advice import ADVICE

FINDING = """
doc_id bigint, finding_type string, severity string, severity_rank int, message string, matched_text string, line_number int,
file_path string, scanner string, finding_id string, pattern_name string, injection_type string, pii_type string,
category string, secret_type string, range struct<start_line:int,start_col:int,end_line:int,end_col:int>, confidence double,
cwe_ids array<string>, auto_fixable boolean, suppressed boolean, suppression_reason string, engine string, seq struct<first:bigint,second:bigint,at:bigint>,
remediation struct<description:string,before:string,after:string,auto_fixable:boolean>,
flow struct<source_line:int,taint_kind:string,hops:array<string>,sink_line:int,sink:string>
"""
#: Name and type of each column; a comma within a type has no blank after it.
_TYPES = dict(p.strip().split(" ", 1) for p in FINDING.replace(",\n", ", ").replace("\n", " ").split(", "))
COLUMNS = tuple(_TYPES)
LEVELS = ("low", "medium", "high")


def shaped(df: DataFrame, *more: str, **given: Column) -> DataFrame:
    """The finding columns in order: given, else the frame's own, else null; then the frame's ``more``."""
    own = {c.lower() for c in df.columns}
    pick = {c: given.get(c, F.col(c) if c in own else F.lit(None)).cast(t) for c, t in _TYPES.items()}
    ident = X.digest(12, *[pick[c] for c in ("doc_id", "scanner", "finding_type", "pattern_name", "injection_type", "pii_type", "seq", "line_number", "matched_text")])
    pick["finding_id"] = F.coalesce(pick["finding_id"], ident)
    pick["severity_rank"] = X.rank(pick["severity"]).cast("int")
    return df.select(*[pick[c].alias(c) for c in COLUMNS], *more)


def _base(docs: DataFrame) -> DataFrame:
    path = F.col("file_path") if "file_path" in docs.columns else F.lit(None).cast("string")
    lang = F.col("language") if "language" in docs.columns else F.lit(None).cast("string")
    # A key of several columns stays the struct that it is.
    key = F.col("doc_id") if dict(docs.dtypes)["doc_id"].startswith("struct") else F.col("doc_id").cast("bigint")
    return docs.select(key.alias("doc_id"), path.alias("file_path"), lang.alias("language"), "text")


def by_line(docs: DataFrame) -> DataFrame:
    """doc_id, file_path, language, line_number (from 1), line."""
    return _base(docs).select("doc_id", "file_path", "language", F.posexplode(X.lines(F.col("text"))).alias("_i", "line")).withColumn("line_number", F.col("_i") + 1).drop("_i")


def bounded(regex: str) -> str:
    """The regex with each word boundary written out by ``\\w``, as Java's own ``\\b`` takes letters of all scripts for words
    before Java 19 even where ``\\w`` is ASCII: with it "12 A Stä" has no street. In a class nothing is a boundary."""
    def out(m: re.Match) -> str:
        if m[0] == "\\b":
            return r"(?<!\w)" if SURE_WORD.match(regex, m.end()) else r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
        return r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))" if m[0] == "\\B" else m[0]

    return CLASSES.sub(out, regex)


#: A word's sign that no quantifier makes optional; before it a boundary is where no word's sign precedes.
SURE_WORD = re.compile(r"(?:\\[dw]|[A-Za-z0-9_])(?![?*{|])")


def regexes(rules, unicode: bool) -> list[str]:
    """With ``unicode``, classes, word boundaries and letter case are those of all scripts."""
    return [("(?U)" if unicode else "") + bounded(r.regex).replace("(?i)", "(?iu)" if unicode else "(?i)") for r in rules]


_RULE = "name string, finding_type string, severity string, said string, confidence double, cwe_ids array<string>, remediation " + _TYPES["remediation"]


def _meta(rules, order: Column) -> Column:
    """What the rules say, by their number: one literal, so that the plan stays small."""
    def fix(name: str) -> dict | None:
        said = ADVICE.get(name)
        return said and {"description": said[0], "before": said[1], "after": said[2], "auto_fixable": name in R.AUTO_FIXABLE}

    rows = [{"name": r.name, "finding_type": r.finding_type, "severity": r.severity, "said": r.message, "confidence": r.confidence, "cwe_ids": list(r.cwe_ids), "remediation": fix(r.name)} for r in rules]
    return F.get(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_RULE}>>".replace(", ", ",")), order.cast("int"))


def _sql(text: str) -> str:
    """A string literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _guard_sql(regex: str) -> str:
    """The guard of a regex; nothing is required with Unicode letters, where a line in lower case may lack what it finds."""
    g = G.Guard() if regex.startswith("(?U)") else G.guard(regex)
    tests = [" OR ".join(f"contains(_low, {_sql(x)})" for x in sorted(g.any_of))] if g.any_of else []
    tests += [f"_digits >= {g.digits}"] if g.digits else []
    return " AND ".join(f"({t})" for t in tests) or "true"


def _first_sql(regex: str, k: int) -> str:
    r = _sql(regex)
    return f"CASE WHEN {_guard_sql(regex)} AND line RLIKE {r} THEN named_struct('at', length(split(line, {r}, 2)[0]), 'hit', regexp_extract(line, {r}, 0), 'order', {k}L) END"


def _every_sql(regex: str, k: int) -> str:
    """A match begins after all pieces up to its own and all matches before it; one fold adds them up."""
    r, none = _sql(regex), "cast(array() as array<struct<at:int,hit:string,order:bigint>>)"
    both = f"filter(zip_with(split(line, {r}, -1), regexp_extract_all(line, {r}, 0), (p, h) -> named_struct('p', p, 'h', h)), x -> x.h IS NOT NULL)"
    step = f"(s, x) -> named_struct('end', s.end + length(x.p) + length(x.h), 'out', concat(s.out, array(named_struct('at', s.end + length(x.p), 'hit', x.h, 'order', {k}L))))"
    return f"CASE WHEN {_guard_sql(regex)} AND line RLIKE {r} THEN aggregate({both}, named_struct('end', 0, 'out', {none}), {step}, s -> s.out) END"


def _hits(lines: DataFrame, rules, regex: list[str], every: bool, groups: list[tuple[str, list[int]]] | None = None) -> DataFrame:
    """One row for each hit of a rule on a line: the first of each rule, or every one.

    ``groups``: a condition on the line, in SQL, and the numbers of the rules that run where it holds; the first that holds
    counts. Guards of the regexes, which are substring tests, come first: lines that pass none of a group's leave at once.
    All of it is one expression in SQL, as building hundreds of expressions call by call takes longer than the scan of a
    small table.
    """
    if not rules:
        rules, regex, groups = R.PII_RULES[:1], ["(?!)"], None
    groups = [(holds, ks) for holds, ks in groups or [("true", list(range(len(rules))))] if ks]
    lines = lines.withColumns({"_low": F.lower("line"), "_digits": G.n_digits(F.col("line"))})
    guards = [_guard_sql(r) for r in regex]
    one = [(_every_sql if every else _first_sql)(r, k) for k, r in enumerate(regex)]
    may = " ".join(f"WHEN {holds} THEN {'true' if any(guards[k] == 'true' for k in ks) else ' OR '.join(guards[k] for k in ks)}" for holds, ks in groups)
    some = " ".join(f"WHEN {holds} THEN filter(array({', '.join(one[k] for k in ks)}), m -> m IS NOT NULL)" for holds, ks in groups)
    hit = F.expr(f"flatten(CASE {some} END)" if every else f"CASE {some} END")
    found = lines.where(F.expr(f"CASE {may} END")).select("*", F.explode(hit).alias("m")).select("*", "m.*", _meta(rules, F.col("m.order")).alias("_rule"))
    return found.select("*", "_rule.*").drop("m", "_low", "_digits", "_rule")


def _line_range() -> Column:
    n = F.col("line_number") - 1
    return F.struct(n.alias("start_line"), F.col("at").alias("start_col"), n.alias("end_line"), (F.col("at") + F.length("hit")).alias("end_col"))


def _seq(*parts: Column) -> Column:
    """The place of a finding among its document's: by line, rule and column unless others are given."""
    first, second, at = parts or (F.col("line_number"), F.col("order"), F.col("at"))
    return F.struct(first.cast("bigint").alias("first"), second.cast("bigint").alias("second"), at.cast("bigint").alias("at"))


def code_rules(sensitivity: str = "medium") -> tuple[list[R.Rule], list[tuple[str, ...]]]:
    """The rules of a sensitivity, each with the language names that it serves; an empty tuple serves all."""
    least = {"low": 3, "medium": 2}.get(sensitivity.lower(), 0)
    tables = [(R.COMMON_RULES, ())]
    for table in dict.fromkeys(R.LANGUAGE_RULES.values()):
        tables.append((table, tuple(k for k, v in R.LANGUAGE_RULES.items() if v is table)))
    kept = [(r, names) for table, names in tables for r in table if R.SEVERITY_RANK[r.severity] >= least]
    return [r for r, _ in kept], [n for _, n in kept]


def scan_code(docs: DataFrame, sensitivity: str = "medium", unicode: bool = False) -> DataFrame:
    """Code rules line by line, the first hit of each; comment lines are passed over. A row whose language has no
    rules of its own, or that has none, gets Python's."""
    return scan_lines(by_line(docs), sensitivity, unicode)


def scan_lines(lines: DataFrame, sensitivity: str = "medium", unicode: bool = False, *more: str) -> DataFrame:
    """The same over rows of ``by_line``, of which the columns ``more`` go along."""
    rules, names = code_rules(sensitivity)
    lines = lines.where(~F.col("line").rlike(X.COMMENT))
    lang = X.language_of(F.col("file_path"), F.col("language"))
    lines = lines.withColumn("_lang", F.when(lang.isin(*R.LANGUAGE_RULES), lang).otherwise("python"))
    everywhere = [k for k, n in enumerate(names) if not n]
    groups = [("_lang IN (" + ", ".join(map(_sql, n)) + ")", everywhere + [k for k, m in enumerate(names) if m == n]) for n in dict.fromkeys(n for n in names if n)]
    hits = _hits(lines, rules, regexes(rules, unicode), False, groups)
    return shaped(hits, *more, message=F.col("said"), matched_text=F.col("hit"), scanner=F.lit("code_scanner"), pattern_name=F.col("name"), range=_line_range(), engine=F.lit("regex"), auto_fixable=F.col("name").isin(*R.AUTO_FIXABLE), suppressed=F.lit(False), seq=_seq())


def check_pii(docs: DataFrame, sensitivity: str = "medium", unicode: bool = False) -> DataFrame:
    """Personal data line by line, every hit; the matched text is a mask."""
    keep = {"low": lambda s: s == "critical", "medium": lambda s: s != "low"}.get(sensitivity, lambda s: True)
    rules = [r for r in R.PII_RULES if keep(r.severity)]
    hits = _hits(by_line(docs), rules, regexes(rules, unicode), True)
    mask = F.coalesce(F.try_element_at(X.literal_map(R.PII_MASKS), F.col("name")), F.lit("***REDACTED***"))
    said = F.concat(F.col("said"), F.lit(" in line "), F.col("line_number").cast("string"))
    return shaped(hits, message=said, matched_text=mask, scanner=F.lit("pii_detector"), pii_type=F.col("name"), range=_line_range(), suppressed=F.lit(False), seq=_seq())


def check_content(docs: DataFrame, sensitivity: str = "medium", blocked: list[str] | None = None, unicode: bool = False) -> DataFrame:
    """Content rules line by line, the first hit of each, by category."""
    allowed = {"low": ("critical",), "high": LEVELS + ("critical", "info")}.get(sensitivity, ("critical", "high", "medium"))
    order = [c for c in blocked if c in R.CONTENT_RULES] if blocked else list(R.CONTENT_RULES)
    rules = [(c, r) for c in order for r in R.CONTENT_RULES[c] if r.severity in allowed]
    kinds = {r.name: c for c, r in rules}
    hits = _hits(by_line(docs), [r for _, r in rules], regexes([r for _, r in rules], unicode), False)
    cat = F.try_element_at(X.literal_map(kinds or {"": ""}), F.col("name"))
    said = F.concat(F.lit("Content violation detected: "), cat, F.lit(" ("), F.col("name"), F.lit(")"))
    return shaped(hits, message=said, matched_text=F.substring("hit", 1, 100), scanner=F.lit("content_moderator"), pattern_name=F.col("name"), category=cat, range=_line_range(), suppressed=F.lit(False), seq=_seq(F.col("order"), F.col("line_number"), F.col("at")))


def check_injection(docs: DataFrame, sensitivity: str = "medium", unicode: bool = False) -> DataFrame:
    """Prompt injections in the whole text, every hit; ranges may cross lines, which only a line feed ends."""
    least = {"low": 4, "high": 0}.get(sensitivity, 2)
    rules = [r for r in R.INJECTION_RULES if R.SEVERITY_RANK[r.severity] >= least]
    whole = _base(docs).where(F.length("text") > 0).withColumn("line", F.col("text"))
    hits = _hits(whole, rules, regexes(rules, unicode), True)

    def place(end: Column) -> tuple[Column, Column]:
        before = F.substring(F.col("text"), F.lit(1), end)
        return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))), F.length(F.element_at(F.split(before, "\n", -1), -1))

    (l0, c0), (l1, c1) = place(F.col("at")), place(F.col("at") + F.length("hit"))
    spot = F.struct(l0.alias("start_line"), c0.alias("start_col"), l1.alias("end_line"), c1.alias("end_col"))
    return shaped(hits, message=F.col("said"), matched_text=F.substring("hit", 1, 100), line_number=l0 + 1, scanner=F.lit("injection_detector"), injection_type=F.col("name"), range=spot, suppressed=F.lit(False), seq=_seq(l0 + 1, F.col("order"), F.col("at")))


#: Our own rules over public token formats: (kind, pattern, flags, severity, confidence).
SECRETS = (
    ("AWS Access Key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "", "critical", 0.95),
    ("AWS Secret Key", r"""aws[a-z_]{0,20}secret[a-z_]{0,20}\s*[:=]\s*["']?[A-Za-z0-9/+=]{40}\b""", "i", "critical", 0.9),
    ("GitHub Token", r"\bgh[pousr]_[A-Za-z0-9]{20,255}\b", "", "critical", 0.95),
    ("Stripe Key", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{8,}\b", "", "critical", 0.95),
    ("Slack Token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b", "", "high", 0.9),
    ("Google API Key", r"\bAIza[0-9A-Za-z_-]{35}\b", "", "high", 0.9),
    ("JWT", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", "", "high", 0.85),
    ("Private Key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "", "critical", 0.99),
    ("Database Connection String", r"""\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:@/"']+:[^\s@/"']+@[^\s"']+""", "i", "critical", 0.9),
    ("OAuth Secret", r"""client[_-]?secret["']?\s*[:=]\s*["'][^"'\s]{8,}["']""", "i", "high", 0.75),
    ("Password in Assignment", r"""(?:password|passwd|pwd)["']?\s*[:=]\s*["'][^"'\s]{4,}["']""", "i", "medium", 0.6),
    ("Token in Assignment", r"""(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|token)["']?\s*[:=]\s*["'][A-Za-z0-9_\-/+=.]{16,}["']""", "i", "high", 0.7),
)


def secret_rules(sensitivity: str = "medium") -> list[R.Rule]:
    least = {"low": 3, "medium": 2}.get(sensitivity.lower(), 0)
    made = [R.Rule(n, p, f, "secret", s, f"{n} detected", c, ("CWE-798",)) for n, p, f, s, c in SECRETS]
    return [r for r in made if R.SEVERITY_RANK[r.severity] >= least]


def check_secrets(docs: DataFrame, sensitivity: str = "medium", unicode: bool = False) -> DataFrame:
    """Secrets line by line, every hit; all but the first four signs are masked."""
    rules = secret_rules(sensitivity)
    hits = _hits(by_line(docs), rules, regexes(rules, unicode), True)
    mask = F.concat(F.substring("hit", 1, 4), F.lit("****"))
    said = F.concat(F.col("said"), F.lit(" in line "), F.col("line_number").cast("string"))
    return shaped(hits, message=said, matched_text=mask, scanner=F.lit("secret_detector"), secret_type=F.col("name"), pattern_name=F.col("name"), range=_line_range(), suppressed=F.lit(False), seq=_seq())


def match_pattern(docs: DataFrame, regex: str) -> DataFrame:
    """Every hit of a caller's regex: doc_id, line_number, start, end, text and the texts of its groups (null: not taken
    part). A broken regex raises at once."""
    docs.sparkSession.range(1).select(F.lit("").rlike(regex)).collect()
    # In Java, as in the pattern's own numbering, an opening bracket that isn't escaped, in a class or (?...) begins a group;
    # a group with a name counts too.
    n = len(GROUP.findall(CLASSES.sub("", regex)))
    found = by_line(docs).where(F.col("line").rlike(regex)).withColumn("_g", F.array(*[F.regexp_extract_all("line", F.lit(regex), F.lit(k + 1)) for k in range(n)]).cast("array<array<string>>"))
    found = found.select("doc_id", "line_number", F.transform("_g", lambda g: F.filter(F.arrays_zip(F.regexp_extract_all("line", F.lit(regex), F.lit(0)).alias("h"), g.alias("g")), lambda x: x["h"] != "")).alias("_g"), F.posexplode(X.all_matches(F.col("line"), regex)).alias("_k", "m"))
    groups = F.transform("_g", lambda g: F.nullif(F.get(g, F.col("_k"))["g"], F.lit("")))
    return found.select("doc_id", "line_number", F.col("m.at").alias("start"), (F.col("m.at") + F.length("m.hit")).alias("end"), F.col("m.hit").alias("text"), groups.alias("groups"))


#: Escaped signs and classes of a regex, and the brackets that begin a group in what is left.
CLASSES, GROUP = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", re.S), re.compile(r"\((?!\?)|\(\?P?<(?![=!])")


def scan_input(docs: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """What a person sends to a model."""
    return check_injection(docs, sensitivity)


def scan_output(docs: DataFrame, sensitivity: str = "medium", blocked: list[str] | None = None) -> DataFrame:
    """What a model sends to a person."""
    return check_pii(docs, sensitivity).unionByName(check_content(docs, sensitivity, blocked))
