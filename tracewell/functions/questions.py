"""Search queries from questions: subject, focus, document query and follow-ups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Words that a query leaves out, the shape of its tokens, yes-or-no openings,
# the focus patterns in order, and the endings of queries with their purposes.
FILLER = (
    "a an and are as at be being by can did do does for from has had have how in is it its of on or so that the their this to was "
    "were what when where which who why will with would evidence shows show quickly distinguishes explanations"
).split()
TOKEN = r"\d[\d,]*(?:\.\d+)?|[\p{L}\p{N}][\p{L}\p{N}'’-]*"
OPENING = r"(?i)^(?:did|does|has|have|is|are|was|were)\b"
DOCUMENTARY = r"(?i)^(?:why|how|when|what (?:factors|led|caused|changed|explains))\b"
SECOND_PART = r"(?i)\band (?:which|what|where|when)\b"
TWO_PARTS = r"(?i)\b(?:did|does|has|have|is|are|was|were)\b.*\band (?:which|what|where|when)\b"
CLAIM = r"(?i)^(?:claim|check this claim)\s*:"
FOCUS = {
    "reviews": r"(?i)\b(?:reviews|ratings?|testimonials?|complaints?|(?:customer|fake|paid|hotel|product) review)\b",
    "attribution": r"(?i)\b(?:authorship|attribution|stolen|plagiari(?:sm|sed|zed)|reposted|copyright|who (?:made|created|photographed))\b",
    "shopping": r"(?i)\b(?:advertised|received|delivered|mismatch|clothing|fabric|wrong product|shopping)\b",
    "brand": r"(?i)\b(?:brand|recall|product safety|company claims)\b",
}
DATA_ENDING = '(data OR statistics OR study OR "annual report")'
STATEMENT_ENDING = '(statement OR clarification OR "press release" OR correction)'
FOLLOW_UPS = {
    "general": [
        ("(history OR timeline OR launch)", "earlier history"),
        ("(study OR research) (causes OR adoption OR mechanisms)", "explanations and research"),
        (
            '("original data" OR "primary source" OR "official statistics") (methodology OR limitations)',
            "underlying measurements and limitations",
        ),
    ],
    "news": [
        ("(data OR statistics OR official) (monthly OR report)", "underlying data"),
        ("(clarification OR correction OR factcheck)", "corrections and opposing evidence"),
        ("(statement OR methodology OR source)", "original statement and methods"),
    ],
    "brand": [
        ("(statement OR recall OR regulator)", "brand and regulator records"),
        ("(independent OR test OR complaint)", "independent tests and complaints"),
        ("(response OR clarification OR correction)", "responses and changed claims"),
    ],
    "reviews": [
        ("(regulator OR investigation OR settlement) reviews", "substantiated review practices"),
        ("(verified purchase OR platform policy OR authenticity) reviews", "review provenance and platform rules"),
        ("(complaints OR positive experiences OR response)", "experiences and responses"),
    ],
    "attribution": [
        ("(original OR author OR first published)", "earlier appearances and attribution"),
        ("(archive OR portfolio OR publication) attribution", "dated attribution records"),
        ("(licence OR permission OR credit)", "rights and attribution claims"),
    ],
    "shopping": [
        ("(specifications OR material OR size guide)", "advertised product specification"),
        ("(returns OR complaints OR batch)", "received-product experiences"),
        ("(test OR response OR refund)", "tests and seller responses"),
    ],
}
SHORT, LONGEST = 100, 350


def focus(question: Column) -> Column:
    """What a question is about, by its wording alone; null for null."""
    found = F.when(question.isNull(), F.lit(None).cast("string"))
    for name, pattern in FOCUS.items():
        found = found.when(question.rlike(pattern), name)
    return found.when(question.rlike(CLAIM) | F.trim(question).rlike(OPENING), "news").otherwise("general")


def subject(question: Column) -> Column:
    """A yes-or-no question without its second part ("and which ..."), unless that part has a digit."""
    parts = F.split(question, SECOND_PART)
    second = F.get(parts, F.lit(1))
    drops = F.trim(question).rlike(OPENING) & F.coalesce(F.length(second) > 0, F.lit(False)) & ~second.rlike(r"\d")
    return F.when(drops, F.get(parts, F.lit(0))).otherwise(question)


def content_tokens(question: Column) -> Column:
    """Tokens of the subject but fillers, space-joined; empty if there are none."""
    tokens = F.regexp_extract_all(subject(question), F.lit(TOKEN), F.lit(0))
    return F.array_join(F.filter(tokens, lambda t: ~F.lower(t).isin(FILLER)), " ")


def _or_else(text: Column, other: Column) -> Column:
    return let(text, lambda t: F.when(t == "", other).otherwise(t))


def document_query(question: Column) -> Column:
    """The query for documents; a short question that asks for no data keeps its wording."""
    data = F.trim(question).rlike(DOCUMENTARY)
    as_it_is = ~data & (F.length(question) <= SHORT) & ~question.rlike(TWO_PARTS)
    base = F.when(as_it_is, question).otherwise(_or_else(content_tokens(question), question))
    return F.concat_ws(" ", base, F.when(data, DATA_ENDING).otherwise(STATEMENT_ENDING))


def follow_ups(question: Column) -> Column:
    """array<struct<q, purpose>>: three further queries by the question's focus, each for another kind of evidence."""
    bare = F.substring(content_tokens(F.regexp_replace(question, CLAIM, "")), 1, LONGEST)
    base = _or_else(bare, question)
    endings = F.create_map(
        *[x for name, ends in FOLLOW_UPS.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(e).alias("e"), F.lit(p).alias("purpose")) for e, p in ends]))]
    )
    chosen = F.element_at(endings, focus(question))
    return let(
        F.struct(base.alias("base"), chosen.alias("chosen")),
        lambda s: F.transform(s["chosen"], lambda c: F.struct(F.concat_ws(" ", s["base"], c["e"]).alias("q"), c["purpose"].alias("purpose"))),
    )


# The label of a claim, the openings of an open question, and the verbs of an assertion.
LABELLED = r"(?is)^(?:claim|check this claim)\s*:\s*(\S.*)$"
OPEN_QUESTION = (
    r"(?i)^(?:who|what|when|where|why|how|is|are|was|were|do|does|did|can|could|should|would|will|has|have|research|investigate|find|tell|review"
    r"|compare|check|assess|evaluate|verify|evidence|information|analysis|topic|whether)\b"
)
ASSERTS = r"(?i)\b(?:is|are|was|were|has|have|had|does|did|causes|caused|contains|contain|proves|proved|fabricated|suppressed)\b"


def explicit_claim(topic: Column) -> Column:
    """The claim that a topic states, by its label or as a declarative sentence; null for a question or a bare topic."""

    def found(text: Column) -> Column:
        labelled = F.regexp_extract(text, LABELLED, 1)
        declares = ~text.contains("?") & ~text.rlike(OPEN_QUESTION) & text.rlike(ASSERTS)
        return F.when(labelled != "", labelled).when(declares, text)

    return let(F.trim(topic), found)
