"""Scalar cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polisgraph.functions import vocabulary as V


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(c) -> Column:
    """Lower case, runs of anything but letters and digits to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def display_label(*candidates, fallback) -> Column:
    """The first candidate that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(_c(c)), F.lit("")) for c in candidates], _c(fallback))


def type_of_id(c) -> Column:
    """Node type by the longest id prefix; null if none is known."""
    out = F.lit(None).cast("string")
    for t, p in sorted(V.PREFIX.items(), key=lambda x: len(x[1])):
        out = F.when(_c(c).startswith(p + "-"), t).otherwise(out)
    return out


def first_last(c) -> Column:
    """``Last, First`` to ``First Last``; other names stay."""
    parts = F.split(_c(c), ",", 2)
    return F.when(F.size(parts) == 2, F.trim(F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0])))).otherwise(F.trim(_c(c)))


def name_key(c) -> Column:
    """Lower case, no punctuation, without company suffixes at the end: what names are compared by."""
    plain = F.trim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(plain, f"(^| )({'|'.join(V.NAME_SUFFIXES)})( ({'|'.join(V.NAME_SUFFIXES)}))*$", ""))


def ein(c) -> Column:
    """All digits of a tax number, or null without any."""
    return F.nullif(F.regexp_replace(_c(c).cast("string"), "[^0-9]", ""), F.lit(""))


def uei(c) -> Column:
    """All letters, upper case, and digits of an entity's id, or null without any."""
    return F.nullif(F.upper(F.regexp_replace(_c(c).cast("string"), "[^A-Za-z0-9]", "")), F.lit(""))


def fingerprint(*columns) -> Column:
    """Eight hex digits that tell rows apart; null parts are empty."""
    return F.substring(F.md5(F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns])), 1, 8)


def public_url(c) -> Column:
    """http and https stay, a leading // becomes https, anything else is no public URL."""
    c = F.trim(_c(c))
    return F.when(c.rlike("^https?://"), c).when(c.startswith("//"), F.concat(F.lit("https:"), c))


def artifact_label(url) -> Column:
    path = F.lower(F.regexp_replace(_c(url), "[?#].*$", ""))
    return F.when(path.endswith(".pdf"), "PDF").when(path.endswith(".html") | path.endswith(".htm"), "Web page").when(path.isNotNull(), "Link")


def html_text(c) -> Column:
    """Text of an HTML page: no scripts, styles, comments or tags, five entities replaced, white space collapsed."""
    out = F.regexp_replace(_c(c), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, "[ \\t\\n\\r]+", " "))


def links(c) -> Column:
    """Targets of all anchors of an HTML page."""
    return F.regexp_extract_all(_c(c), F.lit(r'<a href="([^"]*)"'), F.lit(1))


def parse_date(c) -> Column:
    """The first of several date formats that fits; two-digit years are of this century."""
    c = F.trim(_c(c))
    short = F.regexp_replace(c, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "$1/$2/20$3")
    # A format is tried only on text of its shape: Spark refuses text that its older parser read differently.
    ladder = ((F.substring(c, 1, 10), r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (short, r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (c, r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"), (c, r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"))
    return F.coalesce(*[F.when(text.rlike(shape), F.try_to_date(text, fmt)) for text, shape, fmt in ladder])


def meeting_type(title) -> Column:
    """The first keyword of a title in order of precedence."""
    t, out = F.lower(_c(title)), F.lit("other")
    for word, kind in reversed((("closed session", "closed_session"), ("joint", "joint_meeting"), ("budget", "budget"), ("special", "special"), ("regular", "regular"))):
        out = F.when(t.contains(word), kind).otherwise(out)
    return out


def search_rank(node_type, degree, last_day, as_of: str) -> Column:
    """0 to 100: half a hundred, up to 25 for links, up to 25 for activity in the last three years (25 for days to come),
    and the type's weight; a record has only its links and ten, 30 at most."""
    n, t = _c(degree), _c(node_type)
    linked = F.least(F.lit(25), F.floor(20 * F.log1p(n) / F.log(F.lit(1000.0)) + 1e-9))
    days = F.datediff(F.lit(as_of).cast("date"), F.try_to_date(F.substring(_c(last_day), 1, 10)))
    recent = F.coalesce(F.when(days < 0, 25).otherwise(F.greatest(F.lit(0), 25 - F.floor(25 * days / 1095))), F.lit(0))
    clamp = lambda x, top: F.least(F.lit(top), F.greatest(F.lit(0), x)).cast("int")
    weight = F.lit(0)
    for name, w in V.SEARCH_WEIGHT.items():
        weight = F.when(t == name, w).otherwise(weight)
    return F.when(t == "Record", clamp(linked + 10, 30)).otherwise(clamp(50 + linked + recent + weight, 100))


def title_case(c) -> Column:
    """Underscores to spaces, words with a capital first."""
    return F.initcap(F.replace(_c(c), F.lit("_"), F.lit(" ")))


def joined(sep: str, *parts) -> Column:
    """The parts that are neither null nor blank; null without any."""
    return F.nullif(F.concat_ws(sep, *[F.nullif(_c(p), F.lit("")) for p in parts]), F.lit(""))


def search_label(node_type, node_id, label, kind, day, filer) -> Column:
    """How search results name a node of a type."""
    t, name = _c(node_type), F.coalesce(F.nullif(_c(label), F.lit("")), _c(node_id))
    return (
        F.when(t == "Decision", joined(" · ", name, day))
        .when(t == "Meeting", joined(" — ", name, day))
        .when(t == "Filing", joined(" · ", title_case(kind), filer, day))
        .when(t == "Election", joined(" — ", F.coalesce(_c(kind), F.lit("Election")), day))
        .when(t == "Record", title_case(F.coalesce(_c(kind), F.lit("Record"))))
        .otherwise(name)
    )


def search_terms(node_type, node_id, label, kind, day, filer, url) -> Column:
    """Lower-case words by which a node of a type is found: id, name, and what its type adds."""
    t = _c(node_type)
    host = F.regexp_extract(F.lower(_c(url)), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    when = F.when(t.isin("Decision", "Meeting"), _c(day))
    more = F.when(t.isin("Filing", "Record"), _c(kind))
    by = F.when(t == "Filing", _c(filer))
    name = F.when(~t.isin("Filing", "Record", "Election"), _c(label))
    return F.lower(joined(" ", _c(node_id), name, when, more, by, F.when(t == "Record", host)))


def search_key_fact(node_type, label, kind, status, day, filer) -> Column:
    """A headline of a node of a type; null where its parts are missing."""
    t, name = _c(node_type), F.nullif(_c(label), F.lit(""))
    return (
        F.when(t == "Person", F.lit(None).cast("string"))
        .when(t.isin("Decision", "Case", "Meeting"), joined(" · ", name, F.when(name.isNotNull() | (t != "Decision"), _c(day))))
        .when(t.isin("Project", "Program"), joined(" · ", name, status))
        .when(t == "Filing", joined(" · ", title_case(kind), filer, day))
        .when(t == "Organization", joined(" · ", name, kind))
        .when(t == "Election", joined(" · ", F.coalesce(_c(kind), F.lit("Election")), day))
        .when(t == "Record", title_case(F.coalesce(_c(kind), F.lit("Record"))))
        .otherwise(name)
    )


def synthesis_hash(text, neighbours) -> Column:
    """Changes with a node's text or with the set of its neighbours, not with their order."""
    return F.sha2(F.concat_ws("\n", _c(text), F.array_join(F.array_sort(_c(neighbours)), ",")), 256)
