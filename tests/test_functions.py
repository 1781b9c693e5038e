from pyspark.sql import functions as F

from leadweave.functions import email as E, html as H, name as N, text as T, url as U


def test_site_key(apply):
    cases = {
        "foo.com": None, "http://foo.com:8080/x": "foo.com:8080", "http://u:p@foo.com": "u:p@foo.com",
        "HTTP://WWW.Foo.com/": "foo.com", "http://a b.com/x": "a b.com",
        "https://web-agences.com": "web-agences.com", "": None, None: None, "//www.x.fr?q": "x.fr",
        " https://www.x.fr#top": "x.fr", "https://www.wikipedia.org": "wikipedia.org", "mailto:a@b.c": None,
    }
    assert apply(U.site_key, list(cases)) == list(cases.values())


def test_legacy_site_key_strips_characters(apply):
    got = apply(lambda c: U.site_key(c, legacy=True), ["https://web-agences.com", "https://WWW.x.fr", "http://www.w.fr"])
    assert got == ["eb-agences.com", "www.x.fr", "fr"]


def test_with_scheme(apply):
    cases = {" foo.com ": "https://foo.com", "HTTP://x": "https://HTTP://x", "": "", "http://a": "http://a",
             "https://b": "https://b", None: None, " c.fr": "https://c.fr"}
    assert apply(U.with_scheme, list(cases)) == list(cases.values())


def test_http_url_and_base(apply):
    urls = ["http://a.fr/x", "HTTPS://a.fr", "ftp://a.fr", "http://", "a.fr", None]
    assert apply(U.is_http_url, urls) == [True, True, False, False, False, False]
    assert apply(U.site_base, ["https://a.fr/x?y", "https://?x", None]) == ["https://a.fr", None, None]


def test_listed_site(apply):
    sites = ["x.com", "malt.fr"]
    got = apply(lambda c: U.on_listed_site(c, sites), ["x.com", "netflix.com", "a.b.x.com", "malt.fr:80", None])
    assert got == [True, False, True, False, False]


def test_form_encoding(apply):
    from urllib.parse import quote_plus

    texts = ["agence web Île-de-France", "a*b~c", "x&y=é/ü+", "…"]
    assert apply(U.form_encoded, texts) == [quote_plus(t) for t in texts]


def test_name_key(apply):
    cases = {
        "Société Générale SAS": "societe generale", "agence_web--Lyon": "agence web lyon", "S.A.S": "s a s",
        "SARL": "", "œuvre": "œuvre", "a  b": "a b", "Sasha SA-RL": "sasha rl", "x_sarl": "x sarl",
        "Straße ÅB": "straße ab", "Café́": "cafe", "東京 GmbH": "東京",
    }
    assert apply(N.name_key, list(cases)) == list(cases.values())


def test_location_slug(apply):
    assert apply(N.location_slug, ["Bordeaux", "Île-de-France", " Aix en Provence "]) == [
        "bordeaux", "ile-de-france", "aix-en-provence"]


def test_email_validity(apply):
    cases = {
        "a@example.com": False, "a@mail1.example.com": True, "votre.email@x.fr": False,
        "yourcompanyteam@x.fr": False, "logo@2x.png": False, "a@company": False, "a@b.fr.": False,
        "INFO@Agence.FR": True, "A@EXAMPLE.com": False, "a@b.c": False, "x y@b.fr": False, None: None,
    }
    assert apply(E.is_valid_email, list(cases)) == list(cases.values())


def test_free_email(apply):
    assert apply(E.is_free_email, ["a@Gmail.com", "a@x.fr", "gmail.com", "", None, "a@b@free.fr"]) == [
        True, False, False, False, False, True]


def test_accepted_cleans_and_keeps_first(apply):
    got = apply(lambda c: E.accepted(F.split(c, " ")), ["B@x.fr. a@y.fr b@x.fr) no@example.com"])
    assert got == [["b@x.fr", "a@y.fr"]]


def test_spelled_out(apply):
    cases = {
        "john [at] foo [dot] com": ["john@foo.com"], "john AT foo DOT co DOT uk": ["john@foo.co.uk"],
        "jean arobase foo point fr": ["jean@foo.fr"], "john [at] foo.com": [], "datapointing": ["d@a.ing"],
        "x(at)y(dot)de": ["x@y.de"], "j {at} foo{dot}fr": ["j@foo.fr"], None: [],
    }
    assert apply(E.spelled_out, list(cases)) == list(cases.values())


def test_addresses_in_text(apply):
    import re

    from leadweave.fixed_values import ADDRESS

    texts = ["a@b.co.x@y.com", "x@y.fr,z@w.fr;q@@r.fr", "-a.b+c%d@e-f.museum. a@b", "é@x.fr ü.a@x.fr", "a@b.c1.de@f.gh", ""]
    assert apply(E.in_text, texts) == [re.findall(ADDRESS, t) for t in texts]


def test_long_runs_are_not_quadratic(apply):
    run = "abcdefgh" * 100_000
    assert apply(E.in_text, [run + " a@x.fr " + run]) == [["a@x.fr"]]
    assert apply(E.spelled_out, [run + " dot a at x dot fr " + run]) == [["a@x.fr"]]


def test_visible_text(apply):
    cases = {
        "<p>a</p><p>b</p>": "a b", "x<script>var t='</p>';</script>y": "x y", "a<!-- <p>no</p> -->b": "a b",
        "<style>p{}</style>t": "t", "<template><p>no</p></template>t": "t", "1 < 2": "1 < 2",
        '<a title="x>y">z</a>': "z", "a&amp;b &eacute; &#233; &#xE9; &lt;": "a&b é é é <", "&amp;lt;": "&lt;",
        "&copy &bogus; &": "&copy &bogus; &", "<title>T</title><b>x</b>@<i>y.fr</i>": "T x @ y.fr",
        "t<script>never closed": "t", "t<!-- never closed": "t", "&#x1F600;&#0;": "😀",
        '<?xml version="1.0"?>q': "q",
    }
    assert apply(H.visible_text, list(cases)) == list(cases.values())


def test_many_tags_do_not_need_stack(apply):
    page = "<path d='m'/>" * 50_000 + "x" + "<b a=\"1\" c='2'>" * 20_000
    assert apply(H.visible_text, [page]) == ["x"]


def test_links_and_scripts(apply):
    page = ("<A class=x HREF='mailto:A@x.fr?subject=s'>1</A><a href=mailto:b@x.fr>2</a><!-- <a href='mailto:no@x.fr'> -->"
            '<a data-href="mailto:no@y.fr" href="&#109;ailto:c@x.fr">3</a><abbr href="mailto:no@z.fr">')
    assert apply(lambda c: E.in_links(H.link_targets(H.markup(c))), [page]) == [["A@x.fr", "b@x.fr", "c@x.fr"]]
    page = "<script>var m='mailto:js@x.fr'</script><!--<script>mailto:no@x.fr</script>--><script src=x></script>"
    assert apply(lambda c: E.in_code(H.script_text(c)), [page]) == [["js@x.fr"]]


def test_meta_description(apply):
    cases = {
        '<meta name="description" content="D &amp; d"><meta property="og:description" content="og">': "D & d",
        "<meta content='c' name='description'>": "c",
        '<meta name="description" content=""><meta property="og:description" content="og">': "og",
        '<meta name="Description" content="x">': "", "<p>": "", "<META NAME=description CONTENT=y>": "y",
    }
    assert apply(lambda c: H.meta_description(H.markup(c)), list(cases)) == list(cases.values())


def test_flat_element(apply):
    cases = {"x<main>a<p>b</main>y": "<main>a<p>b</main>", "<x>": "", "<main>a<main>b</main></main>": None, "<main>open": None,
             "<mainframe>x</mainframe>": "", "<MAIN id=q>z</main >": "<MAIN id=q>z</main >"}
    assert apply(lambda c: H.flat_element(c, "main"), list(cases)) == list(cases.values())


def test_body(apply):
    cases = {"<html><head><title>t</title></head><body>b</body>": "b", "<p>x": "x", "<title>t</title>y": "y"}
    assert apply(lambda c: F.trim(H.text_of(H.body_of(c))), list(cases)) == list(cases.values())


def test_boilerplate(apply):
    text = "  Nous utilisons des Cookies. Bonjour  à tous.\nMentions légales . Fin."
    assert apply(T.drop_boilerplate, [text, "", "..."]) == ["Bonjour à tous. Fin", "", ""]


def test_cut(apply):
    words = "word " * 60
    assert apply(T.cut, ["a" * 300, "b" * 301, words + "x", "c" * 200 + "., " + "d" * 200, None]) == [
        "a" * 300, "b" * 300 + "…", words.rstrip()[:299] + "…", "c" * 200 + "…", None]
    assert apply(T.cut_snippet, ["c" * 200 + "., " + "d" * 200]) == ["c" * 200 + ".,…"]


def test_presence(apply):
    assert apply(T.present, ["", None, " ", "x"]) == [False, False, True, True]
    assert apply(T.first_present, [("", "b"), (None, ""), ("a", "b"), (None, None)], "v string, w string") == ["b", "", "a", None]


def test_functions_work_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("Société X",)], "v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v string").parquet(str(tmp_path / "in")).select(N.name_key(F.col("v")).alias("k"))
    query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination(60)
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["societe x"]
