"""Scalar functions and classifiers on inputs whose answers the rules fix."""

import hashlib

import pytest
from pyspark.sql import functions as F

from marlstone.functions import arrangements as A
from marlstone.functions import experience, html, keys, location, primitives, salary, skills, taxonomy, titles, urls

URLS = {
    "HTTP://Example.COM:80/a/b//?utm_source=x&b=2&a=1&ref=q#top": "http://example.com/a/b?a=1&b=2",
    "https://user@x.com/": None,
    "http://x.com": "http://x.com/",
    "https://bücher.de/?q=a b": None,
    "https://x.com/?q=a+b&q=a%20c&=3": "https://x.com/?=3&q=a+b&q=a+c",
    "ftp://x": None,
    "http://[::1]:443/x": "http://[::1]:443/x",
    "http://a_b.com/": None,
    "https://a.com/p?x&y=": "https://a.com/p?x=&y=",
    "https://www.a.com./": "https://www.a.com/",
    "  ": None,
}


@pytest.mark.parametrize("url,want", URLS.items())
def test_url_in_python(url, want):
    assert urls.url_of(url) == want


def test_url_native_agrees_with_python(spark):
    more = ["http://x.com/%7Euser", "https://A.b-c.D:0443/", "https://1.2.3.4/", "https://x.com/?a=1&a=0&&b", "https://bücher.de/ä", "http://x.com:99999/", "http://x..com/", "http://xn--bcher-kva.de/", None]
    df = spark.createDataFrame([(u,) for u in [*URLS, *more]], "u string")
    for r in df.select("u", urls.normalize_url(F.col("u")).alias("v"), urls.normalize_domain(F.col("u")).alias("d")).collect():
        assert r.v == urls.url_of(r.u), r
        assert r.d == urls.domain_of(r.u), r


def test_domains():
    for text, want in {"www.Acme.com.": "acme.com", "https://me@acme.co.uk:8080/x": "acme.co.uk", "localhost": None, "10.0.0.1": None, "acme.com:x": None, "": None, "[::1]": None}.items():
        assert urls.domain_of(text) == want, text


def test_keys(spark):
    df = spark.createDataFrame([(" P ", "S", "t", "j", None), ("p", "s", " ", "j", None), ("p", "s", None, None, "http://x/"), ("p", "s", "t", None, None)], "p string, s string, t string, j string, u string")
    k = keys.natural_key(*[F.col(c) for c in "pstju"])
    rows = df.select(k["domain"].alias("d"), keys.key_hash(k).alias("h")).collect()
    assert [r.d for r in rows] == ["tenant", "no_tenant", "url", None]

    def want(domain, *parts):
        data = bytes([1, domain]) + b"".join(len(p).to_bytes(4, "big") + p.encode() for p in parts)
        return int.from_bytes(hashlib.sha256(data).digest()[:8], "big", signed=True)

    assert [r.h for r in rows] == [want(1, "p", "s", "t", "j"), want(2, "p", "s", "j"), want(3, "p", "s", "http://x/"), None]


def test_json_hash():
    assert keys.json_hash_of('{"b": 1.0, "a": "é"}') == hashlib.sha256(b'{"a":"\\u00e9","b":1.0}').hexdigest()
    with pytest.raises(ValueError):
        keys.json_hash_of('{"a": NaN}')


HTML = {
    "<p>a  b<br>c</p><p>d &amp; e</p>": ("a b\nc\nd & e", None),
    "x<script>var t='</p>'</script>y": ("xy", None),
    "<style>p{}": (None, "unclosed-script-or-style"),
    "a<SCRIPT src='x>y'>1</script >b<script/>c": ("abc", None),
    "</script>a": ("a", None),
    "a\n<p>b</p>\n\n\n<div>c</div>": ("a\n\nb\n\nc".replace("\n\nb", "\nb"), None),
    '<a title="1 > 2" href=x>link</a> 3 < 4 &lt;b&gt; &eacute;&#x41;&nbsp;z': ("link 3 < 4 <b> éA\u00a0z", None),
    "&amp;lt; &amp;amp;": ("&lt; &amp;", None),
    "<!-- <p>no</p> -->a<!DOCTYPE html>b<?php x ?>c</>d": ("abcd", None),
    "<ul><li>one<li>two</ul>three": ("one\ntwo\nthree", None),
    "a\r\nb&#13;c&#10;<p>d": ("a\nb\nc\nd", None),
    "  \t <b> a </b>\t": (" a ", None),
    "<pre>x</pre><header>y</header>": ("xy", None),
    "R&D <b": ("R&D <b", None),
    "": ("", None),
    None: (None, None),
}
ESCAPED = {
    "&lt;p&gt;a&lt;/p&gt;": ("a", None),
    "<p>&lt;": (None, "mixed-literal-and-escaped-markup"),
    "a &lt b": (None, "unsupported-angle-reference"),
    "&amp;lt;b&amp;gt;": (None, "residual-nested-encoding"),
    "&#60;p&#x3E;x &amp;amp; y": ("x & y", None),
    "&lt;style&gt;": (None, "unclosed-script-or-style"),
    "<p>plain</p>": ("plain", None),
    None: (None, None),
}


@pytest.mark.parametrize("mode,cases", [("standard", HTML), ("declared-double-escaped", ESCAPED)])
def test_html(spark, mode, cases):
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    for r in df.select("x", html.html_to_text(F.col("x"), mode).alias("r")).collect():
        assert tuple(r.r) == cases[r.x], r.x
    with pytest.raises(ValueError):
        html.html_to_text(F.col("x"), "other")


def test_redaction_and_text(spark):
    df = spark.createDataFrame([("mail a.b@c.org or +1 (555) 010-9999 now", 1), ("v1234567890x", 2), ("​ \x1c", 3)], "t string, k int")
    rows = df.select(html.redact_contacts(F.col("t")).alias("r"), primitives.is_meaningful(F.col("t")).alias("m")).collect()
    assert rows[0].r == "mail [REDACTED_EMAIL] or [REDACTED_PHONE] now" and rows[1].r == "v1234567890x"
    assert [r.m for r in rows] == [True, True, False]


def test_salary(spark):
    cases = {
        "$120,000 - $150,000 USD per year": (120000, 150000, "USD", "annual"),
        "$120-150k": (120000, 150000, None, None),
        "up to £30,000 annually": (None, 30000, "GBP", "annual"),
        "base pay: $80,000+": (80000, None, None, None),
        "$10 GBP": (10, 10, None, None),
        "€50.000": (None, None, "EUR", None),
        "USD 5 per week": (None, None, "USD", None),
        "150 - 120 USD": (None, None, "USD", None),
        "salary: ＄100k": (100000, 100000, None, None),
        "120-150k": (None, None, None, None),
        None: (None, None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    for r in df.select("x", salary.classify_salary(F.col("x")).alias("r")).collect():
        assert tuple(v.value for v in r.r) == cases[r.x], r.x
        assert all((v.value is None) == (v.provenance == "unavailable") for v in r.r)


def test_location(spark):
    cases = {"Remote, US": (None, "United States", None), "New York, ny": ("NY", "United States", None), "Denver, CO": (None, None, None), "Austin, TX 78701-1234": ("TX", "United States", "78701-1234"), "Toronto, Ontario, Canada": (None, "Canada", None), "Remote, US (remote)": (None, None, None), "Paris or Lyon, France": (None, None, None), "Washington, D.C.": ("DC", "United States", None), "": (None, None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    for r in df.select("x", location.classify_location(F.col("x")).alias("r")).collect():
        assert (r.r.state.value, r.r.country.value, r.r.postal_code.value) == cases[r.x], r.x
        assert r.r.city.value is None


TITLES = {
    "Senior Software Engineer": ("software-engineer", "matched"),
    "Engineering Manager - Security": ("engineering-manager", "matched"),
    "Ｐｒｏｄｕｃｔ Manager": ("product-manager", "matched"),
    "[Expression of Interest] Product Manager": ("product-manager", "matched"),
    "Director of Engineering": ("engineering-director", "matched"),
    "Software\tEngineer (Software Engineer)": ("software-engineer", "matched"),
    "Software Engineer – Berlin": ("software-engineer", "matched"),
    "Software Engineer / Data Scientist": (None, "ambiguous"),
    "Product Security Engineer": (None, "ambiguous"),
    "Director, Software Engineer": (None, "ambiguous"),
    "Manager of Software Engineer": (None, "ambiguous"),
    "Recruiter / Account Executive": (None, "ambiguous"),
    "Software Engineer, Tech Lead II": (None, "ambiguous"),
    "Software Engineering": (None, "unsupported"),
    "Sales Engineer": (None, "unsupported"),
    "---": (None, "unsupported"),
    "Engineer №1": (None, "unsupported"),
    "Ingénieur": (None, "unsupported"),
    " \t": (None, "no_title"),
    "": (None, "no_title"),
    None: (None, "no_title"),
}


def test_titles(spark):
    long = ("Software Engineer, " * 2_000)[:-2]
    df = spark.createDataFrame([(t,) for t in [*TITLES, long]], "t string")
    for r in df.select("t", titles.classify_title(F.col("t")).alias("r")).collect():
        name, outcome = TITLES.get(r.t, ("software-engineer", "matched"))
        assert (r.r.canonical_title.value, r.r.outcome) == (name, outcome), r.t
        assert r.r.canonical_title.provenance == r.r.role_family.provenance == ("inferred" if name else "unavailable")


def test_arrangements():
    assert A.remote_type_of("Engineer (Remote)", None) == ("remote", "inferred")
    assert A.remote_type_of(None, "Not remote, hybrid.") == ("hybrid", "parsed_description")
    assert A.remote_type_of("Remote Sensing Engineer", "We offer a remote stipend role") == (None, "unavailable")
    assert A.employment_type_of(None, "A full-time position, not a part-time role") == ("full_time", "parsed_description")
    assert A.employment_type_of("Contract, Full Time", None) == ("full_time", "inferred")
    assert A.seniority_of("Sr. Staff Engineer", None) == ("staff", "inferred")
    assert A.seniority_of(None, "This role is not a junior or a senior role") == (None, "unavailable")


def test_experience():
    assert experience.experience_of("Engineer (5+ years)", None)[:2] == (5, "inferred")
    assert experience.experience_of(None, "This role requires 3 to 5 years of experience.") == (3, "parsed_description", 5, "parsed_description")
    assert experience.experience_of("Engineer, 3-5 years, preferred", None) == (None, "unavailable", None, "unavailable")
    assert experience.experience_of(None, "We need 2.5 years of experience.") == (None, "unavailable", None, "unavailable")
    assert experience.experience_of(None, "No experience required.")[0] == 0
    assert experience.experience_of("7 years experience", "You must have up to 3 years experience.") == (None, "unavailable", None, "unavailable")


def test_skills_and_taxonomy():
    r = skills.Reader()
    assert [s[0] for s in r.skills("Go Developer", "Skills: Python, R. We like go.")] == ["golang", "python", "rlang"]
    assert [s[0] for s in r.skills(None, "Proficient in Python, Go, or Java.")] == ["golang", "java", "python"]
    assert r.skills("Go to market", "go") == []
    for bad in ([("a", "A", ["x"]), ("b", "B", ["x"])], [("a", "A", ["a"])], [("A", "A", [])], [("a", "B", [])], [("a", "A", []), ("a", "A", [])]):
        with pytest.raises(taxonomy.TaxonomyError):
            taxonomy.index(bad)


def wide(text):
    """Full-width forms of ASCII."""
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)


def swapped(text):
    return text.swapcase()


def spaced(text):
    return f"\t {text} \n"


def broken(text):
    """A zero-width space within."""
    return text[:3] + "​" + text[3:]


def test_titles_under_transforms(spark):
    """Width, case and outer white space change nothing; a character without a place in a title makes it unsupported."""
    plain = [t for t in TITLES if t and t.isascii() and t.strip(" \t-")]
    rows = [(t, f.__name__, f(t)) for t in plain for f in (wide, swapped, str.upper, spaced, broken)]
    df = spark.createDataFrame(rows, "t string, how string, x string")
    for r in df.select("t", "how", titles.classify_title(F.col("x")).alias("r")).collect():
        want = (None, "unsupported") if r.how == "broken" else TITLES[r.t]
        assert (r.r.canonical_title.value, r.r.outcome) == want, r


@pytest.mark.parametrize("change", [wide, str.upper, spaced])
def test_classifiers_under_transforms(change):
    for title, text in (("Engineer (5+ years)", None), (None, "This role requires 3 to 5 years of experience."), ("Engineer, 3-5 years, preferred", None), (None, "No experience required.")):
        assert experience.experience_of(title and change(title), text and change(text)) == experience.experience_of(title, text), (title, text)
    for fn, title in ((A.remote_type_of, "Engineer (Remote)"), (A.employment_type_of, "Contract, Full Time"), (A.seniority_of, "Sr. Staff Engineer")):
        assert fn(change(title), None) == fn(title, None), title
