"""Marked-up editions: scan, recovery, units and decided ranges."""

import pytest

from lexarium.operators import editions as E

NONE = frozenset()


def texts(units):
    return {u["unit_id"]: [x["text"] for x in u["lines"]] for u in units}


def read(body, collection=False, splits=(), forced=NONE):
    return E.read("K", f"<TEI><text>{body}</text></TEI>", collection, list(splits), forced)


def test_text_of_a_line():
    u = read('<body><sp><speaker>Mac.</speaker><l>To <hi>mor</hi><g ref="char:EOLhyphen"/>\n row <note>x <l>no</l></note> and<gap extent="1 word"/> <p>in</p>  ner</l></sp><stage><p>Exit</p></stage></body>')
    assert [(x["text"], x["in_sp"], x["parent"]) for x in u[0]["lines"]] == [("To morrow and in ner", True, "sp")]
    assert u[0]["dropped_stage"] == 1 and u[0]["dropped_note"] == 1 and u[0]["n_speeches"] == 1


def test_recovery_keeps_what_is_there():
    whole = "<TEI><text><body><div type='play'><l>one &amp; two</l><l>three</l></div></body></text></TEI>"
    for broken in (whole.replace("</l><l>", "</b></l><l>"), whole[:-20], whole.replace("&amp;", "&"), whole.replace("</div>", "")):
        u = E.read("K", broken, False, [], NONE)
        assert texts(u) == {"K": ["one & two", "three"]} and not u[0]["well_formed"]
    assert E.read("K", whole, False, [], NONE)[0]["well_formed"]
    assert E.read("K", whole.replace("<text>", "<x>").replace("</text>", "</x>"), False, [], NONE) == []
    for empty in (None, "", "  ", "words only", "<"):
        assert E.read("K", empty, False, [], NONE) == []


def test_declared_encoding_is_not_used():
    assert texts(E.read("K", '<?xml version="1.0" encoding="ISO-8859-1"?><TEI><text><body><p>é</p></body></text></TEI>', False, [], NONE)) == {"K": ["é"]}


def test_works_and_rests():
    d = lambda kind, inner: f'<div type="{kind}">{inner}</div>'
    p = lambda x: f"<p>{x}</p>"
    assert texts(read("<body>" + d("play", p("a")) + "</body>")) == {"K": ["a"]}
    assert texts(read("<body>" + d("play", p("a")) + d("masque", p("b")) + p("c") + "</body>")) == {"K.1": ["a"], "K.2": ["b"], "K.0": ["c"]}
    assert texts(read("<body>" + d("play", p("a")) + d("play", p("b")) + d("act", p("c")) + "</body>")) == {"K": ["a", "b", "c"]}
    assert texts(read("<body>" + d("section", d("play", p("a")) + d("play", p("b")) + p("r")) + "</body>")) == {"K.1": ["a"], "K.2": ["b"], "K.0": ["r"]}
    parts = d("part", "<head>The first part</head>" + p("a")) + d("part", p("b"))
    assert texts(read(f"<body>{parts}</body>")) == {"K.1": ["a"], "K.2": ["b"]}
    assert texts(read(f"<body>{parts.replace('first part', 'scene')}</body>")) == {"K": ["a", "b"]}
    assert texts(read("<body>" + d("pageant", parts.replace("first part", "x")) + p("z") + "</body>", collection=True)) == {"K.1.1": ["a"], "K.1.2": ["b"], "K.0": ["z"]}
    nested = d("masque", p("a") + d("masque", p("b") + d("masque", p("c") + d("masque", p("d") + d("masque", p("e"))))))
    assert texts(read(f"<body>{nested}</body>", collection=True)) == {"K.1.1.1.1": ["d", "e"], "K.1.1.1.0": ["c"], "K.1.1.0": ["b"], "K.1.0": ["a"]}
    group = "<group><text><body>" + p("a") + "</body></text><text><group><text><body>" + p("b") + "</body></text></group></text></group>"
    assert texts(read(group)) == {"K.1": ["a"], "K.2.1": ["b"]}
    sections = "<body>" + d("play", d("section", p("a")) + d("section", p("b"))) + "</body>"
    assert texts(read(sections, collection=True)) == {"K.1": ["a", "b"]}
    assert texts(read(sections, collection=True, forced=frozenset({"K.1"}))) == {"K.1.1": ["a"], "K.1.2": ["b"]}


def test_every_line_is_in_one_unit():
    body = "<body>" + "".join(f'<div type="{k}"><p>{k}</p><div type="play"><l>x</l></div></div>' for k in ("play", "poem", "masque", "text")) + "<p>z</p></body>"
    for collection in (False, True):
        seen = [x["node_path"] for u in read(body, collection) for x in u["lines"]]
        assert len(seen) == len(set(seen)) == 9


def split(first, last, part="1", residual=False, container="/TEI[1]/text[1]/body[1]"):
    return {"unit_id": "K", "part": part, "container": container, "first": first, "last": last, "div_type": "poem", "residual": residual}


def test_decided_ranges():
    body = "<body><p>a</p><p>b</p><p>c</p></body>"
    assert texts(read(body, splits=[split(2, 2, residual=True)])) == {"K.1": ["b"], "K.0": ["a", "c"]}
    assert texts(read(body, splits=[split(1, 1), split(2, 3, "2")])) == {"K.1": ["a"], "K.2": ["b", "c"]}
    for wrong, why in (([split(1, 2)], "in no part"), ([split(2, 4)], "range"), ([split(1, 2), split(2, 3, "2")], "overlap"), ([split(1, 1, container="/TEI[1]/teiHeader[1]")], "no container")):
        with pytest.raises(ValueError, match=why):
            read(body, splits=wrong)


def test_heads_and_gaps():
    u = read('<body><head>Book</head><div type="poem"><head>Poem</head></div><div type="play"><head>A <hi>Play</hi></head><p>x<gap reason="missing" extent="2 pages"/></p></div></body>')
    assert u[0]["head"] == "A Play" and u[0]["missing_gaps"] == 1 and u[0]["missing_extent"] == "2 pages"


def test_frames(spark):
    files = spark.createDataFrame([(1, "<TEI><text><front><p>f</p></front><body><p>a</p></body></text></TEI>", None), (2, None, False), (3, "", True)], "key long, xml string, collection boolean")
    assert [(r.key, r.unit_id, r.text) for r in E.unit_lines(E.units(files)).collect()] == [("1", "1", "a")]
    assert [(r.key, r.section, r.text) for r in E.front_and_back(files).collect()] == [("1", "front", "f")]
    assert E.units(files.limit(0)).count() == 0
