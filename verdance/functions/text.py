"""From free text to typed predicates, as Column functions: lines, sections, extractors, cue phrases.

Everything is a projection: a document's sentences are an array, so nothing is shuffled until the
caller explodes and groups them. Patterns are Java's with (?U), so that classes know Unicode.

Defined cases: a null or empty text has no sentences; a sentence that no pattern fits is NULL."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .logic import NODE_FIELDS, TREE, key, let, literal, node

# Word lists, limits and patterns of the extraction.
LINE_BREAK = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c-\\u001e\\u0085\\u2028\\u2029]"
ESCAPE = r"\\([^A-Za-z0-9\s])"
HEADER = r"(?iU)^\s*(inclusion|exclusion)\s+criteria\b\s*:?\s*$"
BULLET = r"(?U)^\s*(?:[-*•·]|\(?\d+\\?[.)])\s*"
LEAST_CHARS, MOST_CHARS, MOST_WORDS, MOST_PARTS = 12, 180, 6, 3
BOILERPLATE = [
    "informed consent", "written consent", "able to", "willing to", "willingness",
    "in the opinion of the investigator", "per investigator", "any other",
    "as determined by", "participants who", "subjects who", "patients who",
]
MEASUREMENTS = [
    "hba1c", "a1c", "bmi", "body mass index", "egfr", "creatinine", "hemoglobin",
    "haemoglobin", "platelet count", "platelets", "ldl", "ldl-c", "hdl", "triglycerides",
    "systolic blood pressure", "diastolic blood pressure", "ejection fraction", "weight",
    "alt", "ast", "bilirubin", "fasting plasma glucose", "fasting blood glucose",
]
PROCEDURE_SUFFIXES = [
    "management", "monitoring", "surgery", "resection", "fixation", "biopsy",
    "transplantation", "dissection", "catheterization", "ventilation", "dialysis",
    "intubation", "endoscopy", "imaging", "screening",
]
DRUG_CUES = ["treatment with", "therapy with", "use of", "receiving", "taking", "treated with"]
CONDITION_CUES = ["history of", "diagnosis of", "diagnosed with", "patients with", "presence of", "known", "documented", "confirmed"]
UNIT_STOPWORDS = [
    "and", "or", "at", "in", "on", "of", "to", "the", "a", "an", "for", "with", "per",
    "times", "x", "within", "before", "after", "who", "if", "as", "is", "are", "was",
]
COMPARATORS = {"<": "lt", "≤": "le", "<=": "le", ">": "gt", "≥": "ge", ">=": "ge"}
RELATIVE_BOUND = r"(?iU)^\s*(?:times|x|×|\*)?\s*(?:the\s+)?(?:uln|lln|upper limit|lower limit)"
UNIT = "(?U)^\\s*([%A-Za-zµμ][A-Za-z0-9µμ%^/·.\\-²³]{0,14})"
ENUMERATION = r"(?iU),\s*(?:[^,]{1,40}\s+)?(?:or|and)\s+"
INLINE_BOUND = "(?iU)[<>≤≥]|\\b\\d+\\s*(?:%|mg|ml|kg|g/l|mmhg|um|µm)\\b"
CLAUSE_TAIL = r"(?iU)\s+(?:prior to|within|before|after|during|at screening|at baseline|in the past|who|which|that|whose)\b"
LEADING = r"(?iU)^\s*(?:a|an|the|any|all|other|current|currently|ongoing|active|known|suspected|prior|previous|recent|past|planned|or|and|of|to|with)\s+"
TRAILING = r"(?iU)\s+(?:such|including|include|e\.?g\.?|i\.?e\.?|with|of|to|in|at|for|from|by|than|and|or|as|the|a|an|currently|recently|previously|prior|regularly|now)\s*$"
TIME_UNIT = "(day|days|week|weeks|month|months|year|years)"
WITHIN = rf"(?iU)\bwithin\s+(?:the\s+)?(?:past|last|previous\s+)?\s*(\d+)\s*{TIME_UNIT}\b"
FOR_AT_LEAST = rf"(?iU)\bfor\s+at\s+least\s+(\d+)\s*{TIME_UNIT}\b"
EVER = r"(?iU)\bhistory of\b|\bever\b|\bprevious(?:ly)?\b|\bprior\b"
CURRENT = r"(?iU)\bcurrent(?:ly)?\b|\bongoing\b|\bactive\b"
AGE_RANGE = ["(?U)\\bages?d?\\s*(?:between\\s+)?(\\d{1,3})\\s*(?:-|–|to|and)\\s*(\\d{1,3})\\s*years?\\b", "(?U)\\b(\\d{1,3})\\s*(?:-|–|to)\\s*(\\d{1,3})\\s*years?\\s*(?:of age|old)\\b"]
AGE_MIN = [r"(?U)\b(?:age[d]?\s*)?(\d{1,3})\s*years?\s*(?:of age\s*)?(?:or older|and older|and above)\b", "(?U)\\bage[d]?\\s*(?:>=|≥|at least|greater than or equal to|older than|over)\\s*(\\d{1,3})\\b"]
AGE_MAX = "(?U)\\bage[d]?\\s*(?:<=|≤|at most|less than or equal to|younger than|under)\\s*(\\d{1,3})\\b"
NEGATION = r"(?iU)^no\s+(?:history\s+of\s+|known\s+|evidence\s+of\s+|prior\s+|current\s+)?|^absence\s+of\s+|^without\s+|^free\s+of\s+|^not\s+(?:receiving|taking|treated\s+with|currently)\s+"

#: The decimal digits of all scripts beyond ASCII, which \\d matches under (?U), and what each stands for.
DIGITS = {chr(c): str(unicodedata.digit(chr(c))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}

#: White space, as \\s has it under (?U).
SPACES = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Letters that a pattern takes for others when it ignores case, though lower() doesn't: long s, kelvin, i without and with a dot.
FOLDED, PLAIN = "\u017f\u212a\u0131\u0130", "skii"
#: The first words of what the extractors look for: a sentence without any is passed over after one look at its words.
WORDS_OF = {
    "measurement": sorted({m.replace("-", " ").split()[0] for m in MEASUREMENTS}),
    "cue": sorted({c.split()[0] for c in DRUG_CUES + CONDITION_CUES}),
}

HIT = f"struct<tree:{TREE},pattern:string>"
SENTENCES = "array<struct<pos:int,section:string,sentence:string>>"


def number_of(x: Column) -> Column:
    """The double that a run of digits of any script states; NULL if it states none."""
    return F.translate(x, "".join(DIGITS), "".join(DIGITS.values())).try_cast("double")


def stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def squeezed(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends; a pattern is looked for only where two blanks meet."""
    plain = F.translate(x, SPACES, " " * len(SPACES))
    return let(plain, lambda p: F.btrim(F.when(F.contains(p, F.lit("  ")), F.regexp_replace(p, " +", " ")).otherwise(p)))


def unescaped(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("\\")), F.regexp_replace(x, ESCAPE, "$1")).otherwise(x)


def sentences(text: Column) -> Column:
    """The lines of a text as (pos, section, sentence): the section of the last header carries forward, `inclusion` before any.

    Marked lines cut the text in stretches of one section each, so each line is looked at once however many marks there are."""
    raw = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), lambda x, i: F.struct(i.alias("pos"), stripped(unescaped(x)).alias("l")))

    def marked(x: Column) -> Column:
        line, low = x["l"], F.lower(x["l"])
        named = F.contains(low, F.lit("criteria")) | F.rlike(line, F.lit("[\u0131\u0130]"))
        header = named & F.rlike(line, F.lit(HEADER))
        inline = F.when(F.startswith(low, F.lit("inclusion criteria")), "inclusion").when(F.startswith(low, F.lit("exclusion criteria")), "exclusion")
        rest = F.when(inline.isNotNull(), stripped(F.regexp_replace(line, "(?s)^[^:]*:", ""))).otherwise(line)
        letter = lambda r: F.ascii(r).between(65, 122)  # noqa: E731  then there is no bullet
        sentence = let(rest, lambda r: F.when(letter(r), squeezed(r)).otherwise(squeezed(F.regexp_replace(r, BULLET, ""))))
        return let(header, lambda h: F.struct(x["pos"].alias("pos"), F.when(h, F.lower(F.regexp_extract(line, HEADER, 1))).otherwise(inline).alias("mark"), F.when(~h, sentence).alias("sentence")))

    lines = F.transform(F.filter(raw, lambda x: x["l"] != ""), marked)

    def placed(all_: Column) -> Column:
        """Stretches: where each begins and its section; the first one is before any mark."""
        starts = F.filter(F.transform(all_, lambda x, i: F.struct(i.alias("at"), x["mark"].alias("section"))), lambda m: m["section"].isNotNull())
        return let(F.struct(all_.alias("lines"), F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit("inclusion").alias("section"))), starts).alias("starts")), cut)

    def cut(b: Column) -> Column:
        def stretch(m: Column, k: Column) -> Column:
            end = F.coalesce(F.get(b["starts"], k + 1)["at"], F.size(b["lines"]))
            own = F.filter(F.slice(b["lines"], m["at"] + 1, end - m["at"]), lambda x: F.coalesce(x["sentence"], F.lit("")) != "")
            return F.transform(own, lambda x: F.struct(x["pos"].alias("pos"), m["section"].alias("section"), x["sentence"].alias("sentence")))

        return F.flatten(F.transform(b["starts"], stretch))

    return let(lines, placed)


def first_words(sentence: Column) -> Column:
    """Which of WORDS_OF a sentence has, by one look-up of its words."""
    found = F.split(F.lower(F.translate(sentence, FOLDED, PLAIN)), r"(?U)\W+")
    return F.array_intersect(found, F.array(*(F.lit(w) for words in WORDS_OF.values() for w in words)))


def has_word(words: Column, kind: str) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, WORDS_OF[kind])))


def skipped(sentence: Column) -> Column:
    """Why a sentence isn't looked at: length_out_of_range, boilerplate_phrase or NULL."""
    low = F.lower(sentence)
    phrases = F.array(*map(F.lit, BOILERPLATE))
    return F.when(~F.length(sentence).between(LEAST_CHARS, MOST_CHARS), "length_out_of_range").when(F.exists(phrases, lambda p: F.contains(low, p)), "boilerplate_phrase")


def clean_phrase(phrase: Column) -> Column:
    """A captured phrase trimmed to its concept; NULL if it is coordinated, bounded, too long or too short."""
    head = squeezed(F.regexp_replace(phrase, r"\([^)]*\)", " "))
    head = F.get(F.split(head, r"[,;:\[]", 2), F.lit(0))
    head = F.get(F.split(head, CLAUSE_TAIL, 2), F.lit(0))
    once = lambda p: F.btrim(F.regexp_replace(F.regexp_replace(p, LEADING, ""), TRAILING, ""), F.lit(" ,.;:()[]-"))
    # A pass takes a word at least from either end, so as many passes as words reach the end.
    words = lambda p: F.filter(F.split(p, r"(?U)\s+"), lambda w: w != "")
    trimmed = let(head, lambda h: F.lower(F.aggregate(F.sequence(F.lit(0), F.size(words(h))), h, lambda p, _: once(p))))
    bad = lambda p: ~F.rlike(p, F.lit("[a-z]")) | F.rlike(p, F.lit(r"(?U)\s+(?:and|or)\s+")) | F.rlike(p, F.lit(INLINE_BOUND)) | (F.size(words(p)) > MOST_WORDS) | (F.length(p) < 3)
    return let(trimmed, lambda p: F.when(~bad(p), p))


def _atom(**fields: Column) -> Column:
    """A tree of one atom with the given fields."""
    own = {"kind": F.lit("atom"), "arity": F.lit(0)} | fields
    return F.array(F.struct(*((own[k] if k in own else F.lit(None)).cast(t).alias(k) for k, t in NODE_FIELDS))).cast(TREE)


def _hit(condition: Column, pattern: Column, **fields: Column) -> Column:
    return F.when(condition, F.struct(_atom(**fields).alias("tree"), pattern.alias("pattern")).cast(HIT))


def _first_group(s: Column, patterns: list[str], group: int) -> Column:
    """A group of the first of the patterns that matches."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(F.rlike(s, F.lit(p)), F.regexp_extract(s, p, group)).otherwise(out)
    return out


def age_atom(sentence: Column) -> Column:
    """A range needs a rising one; then a least age; then a greatest."""
    fixed = {"entity": F.lit("age"), "type": F.lit("person"), "num_unit": F.lit("years"), "num_lo_incl": F.lit(True), "num_hi_incl": F.lit(True)}

    def of(s: Column) -> Column:
        return F.when(F.contains(s, F.lit("age")) | F.contains(s, F.lit("year")), found(s))

    def found(s: Column) -> Column:
        lo, hi = number_of(_first_group(s, AGE_RANGE, 1)), number_of(_first_group(s, AGE_RANGE, 2))
        least, most = number_of(_first_group(s, AGE_MIN, 1)), number_of(_first_group(s, [AGE_MAX], 1))
        return F.coalesce(
            _hit(hi > lo, F.lit("age_range"), **fixed, num_op=F.lit("between"), num_value=lo, num_upper=hi),
            _hit(least.isNotNull(), F.lit("age_min"), **fixed, num_op=F.lit("ge"), num_value=least),
            _hit(most.isNotNull(), F.lit("age_max"), **fixed, num_op=F.lit("le"), num_value=most),
        )

    return let(F.lower(sentence), of)


def unit_after(tail: Column) -> Column:
    """The unit at the start of a tail, verbatim; NULL if there is none."""
    found = F.btrim(F.regexp_extract(tail, UNIT, 1), F.lit(" .,;:"))
    return F.when((found != "") & ~F.lower(found).isin(*UNIT_STOPWORDS), found)


def measurement_atom(sentence: Column) -> Column:
    """The longest lexicon name that the sentence has, and the bound that follows it; bounds relative to a normal range don't count."""
    low = F.lower(sentence)
    name = F.lit(None).cast("string")
    for m in sorted(MEASUREMENTS, key=len):
        # The longest name is looked at first, and earlier ones first among equals.
        name = F.when(F.contains(low, F.lit(m)) & F.rlike(low, F.lit(rf"(?U)\b{m}\b")), F.lit(m)).otherwise(name)
    extract = lambda s, p, k: F.call_function("regexp_extract", s, p, F.lit(k))
    fixed = {"type": F.lit("measurement"), "num_lo_incl": F.lit(True), "num_hi_incl": F.lit(True)}

    def of(m: Column) -> Column:
        bound = F.concat(F.lit(r"(?iU)\b"), m, F.lit("\\b[^0-9<>≤≥]{0,24}?(<=|>=|≤|≥|<|>)\\s*([0-9]+(?:\\.[0-9]+)?)(.*)$"))
        span = F.concat(F.lit(r"(?iU)\b"), m, F.lit(r"\b[^0-9]{0,24}?between\s+([0-9.]+)\s+and\s+([0-9.]+)(.*)$"))
        sign, tail = extract(sentence, bound, 1), extract(sentence, bound, 3)
        op = F.lit(None).cast("string")
        for symbol, code in COMPARATORS.items():
            op = F.when(sign == symbol, F.lit(code)).otherwise(op)
        relative = lambda t: F.rlike(t, F.lit(RELATIVE_BOUND))
        lo, hi, far = extract(sentence, span, 1).try_cast("double"), extract(sentence, span, 2).try_cast("double"), extract(sentence, span, 3)
        threshold = _hit(~relative(tail), F.lit("measurement_threshold"), **fixed, entity=m, num_op=op, num_value=extract(sentence, bound, 2).try_cast("double"), num_unit=unit_after(tail))
        range_ = _hit((hi > lo) & ~relative(far), F.lit("measurement_range"), **fixed, entity=m, num_op=F.lit("between"), num_value=lo, num_upper=hi, num_unit=unit_after(far))
        return F.when(m.isNull(), F.lit(None).cast(HIT)).when(sign != "", threshold).otherwise(range_)

    return let(name, of)


def temporal_of(sentence: Column) -> Column:
    """struct(op, value, unit) of the first cue of time, or NULL."""

    def window(op: str, pattern: str) -> Column:
        unit = F.lower(F.regexp_extract(sentence, pattern, 2))
        plural = F.when(F.endswith(unit, F.lit("s")), unit).otherwise(F.concat(unit, F.lit("s")))
        return F.when(F.rlike(sentence, F.lit(pattern)), F.struct(F.lit(op).alias("op"), number_of(F.regexp_extract(sentence, pattern, 1)).alias("value"), plural.alias("unit")))

    bare = lambda op, pattern: F.when(F.rlike(sentence, F.lit(pattern)), F.struct(F.lit(op).alias("op"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit")))
    return F.coalesce(window("within", WITHIN), window("for_at_least", FOR_AT_LEAST), bare("any_history", EVER), bare("current", CURRENT))


def cued_atom(sentence: Column) -> Column:
    """The concept after the first cue that leaves a clean phrase; enumerations and windows of no length give NULL."""
    folded = F.lower(F.translate(sentence, FOLDED, PLAIN))

    def of(t: Column) -> Column:
        def made(phrase: Column, type_: Column, pattern: Column) -> Column:
            temporal = {"tmp_op": t["op"], "tmp_value": t["value"], "tmp_unit": t["unit"], "tmp_anchor": F.when(t["op"].isNotNull(), "enrollment")}
            return _hit(phrase.isNotNull(), pattern, entity=phrase, type=type_, **temporal)

        def after(cue: str) -> Column:
            pattern = rf"(?iU)\b{cue}\s+(.+)$"
            return F.when(F.contains(folded, F.lit(cue)) & F.rlike(sentence, F.lit(pattern)), clean_phrase(F.regexp_extract(sentence, pattern, 1)))

        def drug(cue: str) -> Column:
            procedure = lambda p: F.exists(F.array(*map(F.lit, PROCEDURE_SUFFIXES)), lambda s: F.endswith(p, s))
            kind = lambda p: F.when(procedure(p), "procedure").otherwise("drug")
            return let(after(cue), lambda p: made(p, kind(p), F.concat(kind(p), F.lit(":" + cue.replace(" ", "_")))))

        def condition(cue: str) -> Column:
            return let(after(cue), lambda p: made(p, F.lit("condition"), F.lit("condition:" + cue.replace(" ", "_"))))

        found = F.coalesce(*map(drug, DRUG_CUES), *map(condition, CONDITION_CUES))
        listed = F.contains(sentence, F.lit(",")) & F.rlike(sentence, F.lit(ENUMERATION))
        return F.when(~listed & F.coalesce(t["value"] > 0, F.lit(True)), found)

    return let(temporal_of(sentence), of)


def sentence_atom(sentence: Column) -> Column:
    """struct(tree, pattern) of the first extractor that fits, or NULL."""
    by_word = lambda w: F.coalesce(F.when(has_word(w, "measurement"), measurement_atom(sentence)), F.when(has_word(w, "cue"), cued_atom(sentence)))
    return F.coalesce(age_atom(sentence), let(first_words(sentence), lambda w: F.when(F.size(w) > 0, by_word(w))))


def sentence_expression(sentence: Column) -> Column:
    """struct(tree, rule, negated) of a sentence, or NULL where it can't be mapped faithfully.

    A leading negation cue is taken off; two or three parts joined by one kind of conjunction become
    a group if each maps to an atom of its own; a single atom must not drop a conjunct."""

    def of(body: Column) -> Column:
        has_or, has_and = F.rlike(body, F.lit(r"(?iU)\s+or\s+")), F.rlike(body, F.lit(r"(?iU)\s+and\s+"))
        parts = F.filter(F.transform(F.split(body, r"(?iU)\s+(?:or|and)\s+"), stripped), lambda p: p != "")
        candidates = F.when(~F.contains(body, F.lit(",")) & ~(has_or & has_and) & F.size(parts).between(2, MOST_PARTS), parts)
        whole = F.transform(candidates, sentence_atom)

        def grouped(atoms: Column) -> Column:
            distinct = F.size(F.array_distinct(F.transform(atoms, lambda a: key(a["tree"])))) == F.size(atoms)
            root = F.when(has_or, literal([node("or", 0)])).otherwise(literal([node("and", 0)]))
            root = F.transform(root, lambda n: n.withField("arity", F.size(atoms)))
            tree = F.concat(F.flatten(F.transform(atoms, lambda a: a["tree"])), root)
            return F.when(F.forall(atoms, lambda a: a.isNotNull()) & distinct, F.struct(tree.alias("tree"), F.when(has_or, "coordinated_or").otherwise("coordinated_and").alias("pattern")).cast(HIT))

        alone = F.when(F.contains(body, F.lit(",")) | ~has_and, sentence_atom(body))
        return F.coalesce(let(whole, grouped), alone)

    def finished(s: Column) -> Column:
        tree = F.when(s["negated"], F.concat(s["hit"]["tree"], literal([node("not", 1)]))).otherwise(s["hit"]["tree"])
        return F.when(s["hit"].isNotNull(), F.struct(tree.alias("tree"), s["hit"]["pattern"].alias("rule"), s["negated"].alias("negated")))

    negated = F.rlike(sentence, F.lit(NEGATION))
    body = F.when(negated, stripped(F.regexp_replace(sentence, NEGATION, ""))).otherwise(sentence)
    hit = let(body, lambda b: F.when(b != "", of(b)))
    return let(F.struct(hit.alias("hit"), negated.alias("negated")), finished)
