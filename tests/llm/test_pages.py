import json
import random

import pytest

from cairn.llm.pages import residue, templates
from cairn.llm.residue import page

STORY = "The exporter keeps every file that the plan names. It was slow until the index came. Nobody had asked for the old one, so it went away last spring."


@pytest.mark.parametrize(
    "text, kind",
    [
        ("# {{ title }}\n\n<YEAR>\n\n## Installation\n\nClone <%= repo %> and run the installer.\n", "template"),
        ("Hello ${name},\n\nyour export [[PROJECT]] is done.\n\nRegards\n__OWNER__\n", "template"),
        ("Title: tbd\nOwner: %%owner%%\nStatus: TBD\n", "template"),
        ("Lorem ipsum dolor sit amet, velum amnis arcus. Umbra silva gravis tellus orbita.", "filler"),
        ("blah\n" * 30, "filler"), ("Start page\n" + "This is a placeholder paragraph.\n" * 4, "filler"),
        ("<html><body><noscript>You need to enable JavaScript to run this app.</noscript><div id='root'></div></body></html>", "script"),
        ("Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "script"), ("Для просмотра включите JavaScript.", "script"),
        ("<html><head><title>502 Bad Gateway</title></head><body><center><h1>502 Bad Gateway</h1></center></body></html>", "error"),
        ('{"message": "Not Found", "status": 404, "request_id": "fbff9cae0c536097"}', "error"), ("Erreur 404\n\nLa page demandée est introuvable. Merci de réessayer plus tard.", "error"),
        ("404\n\n페이지를 찾을 수 없습니다. 주소를 확인해 주세요.", "error"), ("Fel 404\n\nSidan kunde inte hittas.\n", "error"), ("Switch on JS in Firefox to see this application.", "script"), ("Please enable cookies to continue.\n", "error"),
        ("Dear NAME,\n\nthank you for contacting COMPANY about PRODUCT.\n\nRegards", "template"), ("YOUR ADDRESS WAS BLOCKED BY THE FIREWALL OF THE COMPANY. QUOTE INCIDENT 2BFC.\n", "error"),
        ("Page not found\n\nOne stray sentence about the cache that outlived its folder last spring.\n", "error"),
    ],
)
def test_residue(text, kind):
    assert page(text).kind == kind


@pytest.mark.parametrize(
    "text, lang",
    [
        (STORY, None), (f'Issue: the viewer shows "Please enable JavaScript" behind the proxy\n\n{STORY}', None), ('messages:\n  a: "Access denied"\n  b: "Please enable JavaScript"\n  c: "Page not found"\n', "yaml"),
        ("app.use((req, res) => {\n  res.status(404).send('Page not found');\n});\n", "javascript"), ('SAMPLE = "lorem ipsum dolor sit amet"\n\ndef test_words():\n    assert count_words(SAMPLE) == 5\n', "python"),
        ("{% for r in rows %}\n  {{ r.name }}\n{% endfor %}\n{{ title }}\n{{ owner }}\n", "jinja"), ("ok\n", None), ("", None), (None, None),
    ],
)
def test_content(text, lang):
    p = page(text, lang)
    assert p is None or p.kind == ""


def test_tables(spark):
    notice = "Quelltext der Seite 7 fehlt"
    rows = [(1, STORY, None, 0), (2, "Lorem ipsum dolor sit amet velum.", "text", 1), (2, "Lorem ipsum dolor sit amet velum.", "text", 1), (3, None, None, 2), (None, "blah " * 20, None, 3), (4, "", None, 4), (5, notice, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, template long")
    assert {tuple(r) for r in residue(df).collect()} == {(2, "filler", "single")}
    assert residue(df.limit(0)).count() == 0
    assert residue(df.select("doc_id", "text")).count() == 1


def test_a_template_speaks_for_its_pages(spark):
    rows = [(k, "error" if k < 4 else "", "", "t") for k in range(5)] + [(9, "", "error", "u")] + [(20 + k, "", "error", "v") for k in range(4)]
    found = spark.createDataFrame(rows, "doc_id long, kind string, hint string, template string")
    assert {(r.template, r.kind, r.pages) for r in templates(found).collect()} == {("t", "error", 5), ("u", "", 1), ("v", "error", 4)}


def test_pages_of_any_language_by_their_template(spark):
    rows = [(k, f"404\n\nSidan /s/{k} hittades inte.\n") for k in range(4)] + [(9, "Rapport\n\nNågonting annat här 404\n")]
    rows += [(20 + k, "Ota JS käyttöön nähdäksesi tämän sivun") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in residue(df).collect()} == {(k, "error", "repeated") for k in range(4)} | {(20 + k, "script", "repeated") for k in range(4)}


def test_slots_in_no_known_style_show_beside_siblings(spark):
    form = "Delivery note\nCustomer: {}\nThis note was made when the parcel left the hall. Keep it until the parcel has been paid in full.\nDear {}, the driver calls before the parcel comes.\nStreet: {}\nPlease hand this note to the driver. It must not be thrown away before the end of the year.\n"
    filled = [form.format(c, n, s) for c, n, s in (("Harbor Ltd", "Maria", "12 Mill Lane"), ("Quartz Inc", "Jon", "7 Elm Road"), ("Velvet AG", "Pia", "3 High Street"))]
    blank = form.format("~customer~", "~first name~", "?street?")
    rows = [(k, t) for k, t in enumerate([*filled, blank, STORY, form.format("Maple KG", "~first name~", "9 Low Street")])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert page(blank) is None
    assert {tuple(r) for r in residue(df).collect()} == {(3, "template", "slots")}


def test_drawn_filler_of_any_length():
    rng = random.Random(5)
    words = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    text = "\n".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(100))
    assert page(text).kind == "filler" and page(text[:1500]).kind == "filler"
    assert page(text + "\n" + STORY) is None


@pytest.mark.parametrize("element", ["<script>{}</script>", "<style type='text/css'>{}</style>", "<!--\n{}\n-->"])
def test_elements_of_any_size_are_left_out(element):
    if element.startswith("<!"):
        inner = "\n".join("Skip to main content" for _ in range(300))
    else:
        inner = "\n".join(f"window.part{k} = load({k}, 'one more piece of the shell');" for k in range(120))
    text = "<html><head>\n" + element.format(inner) + "\n</head><body><noscript>You need to enable JavaScript to run this app.</noscript></body></html>"
    assert len(text) > 5000 and page(text).kind == "script"


def test_elements_that_are_never_closed():
    assert page("<!-- <script " * 20_000 + STORY) is None


TRACE = "\n".join(f"  at worker.step{k} (worker.js:{k}:7)" for k in range(120))


@pytest.mark.parametrize(
    "text, kind",
    [
        (json.dumps({"error": {"code": 503, "message": "Service unavailable", "details": [{"reason": "backend", "trace": TRACE}]}}), "error"),
        ("<?xml version='1.0'?>\n<Error><Code>NoSuchKey</Code><Message>The key was not found</Message><Trace>" + TRACE + "</Trace></Error>", "error"),
        ("HTTP/1.1 502 Bad Gateway\nServer: edge\nX-Trace: a\n\n" + TRACE, "error"),
        ("Upstream said:\n" + json.dumps({"error": {"code": 503, "details": [{"trace": TRACE}]}}), "error"),
    ],
)
def test_errors_as_data_of_any_length(text, kind):
    assert len(text) > 2000 and page(text).kind == kind


def test_data_that_only_names_an_error():
    p = page(json.dumps({"title": "How the exporter reports an error", "body": STORY}))
    assert p is None or p.kind == ""
