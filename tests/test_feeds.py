"""Feeds of all forms, whole and damaged."""

from tidemill.sources.feeds import entries


def fields(feed, *names):
    return [tuple(e[n] for n in names or ("title", "summary", "link")) for e in entries(feed)]


def test_rss_2():
    feed = """<?xml version="1.0"?><rss><channel><title>Feed</title><link>no</link><item><title>A &amp; B &lt;b&gt;</title><link> u1 </link><description><![CDATA[<p>d & e</p>]]></description><pubDate>p</pubDate></item>
    <item><title/><description>only</description><guid>g</guid><dc:date>u</dc:date></item><item><guid isPermaLink="false">g</guid><content:encoded>c</content:encoded><media:title>no</media:title></item><item/></channel></rss>"""
    assert fields(feed) == [("A & B <b>", "<p>d & e</p>", "u1"), (None, "only", "g"), (None, "c", None), (None, None, None)]
    assert fields(feed, "published", "updated")[:2] == [("p", None), (None, "u")]


def test_atom_and_rss_1():
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title><entry><title type="html">T &lt;i&gt;</title><link rel="self" href="self"/><link rel="alternate" href="a?x=1&amp;y=2"/><updated>u</updated><published>p</published>
    <author><name>n</name></author><source><title>other</title><updated>no</updated></source><content type="xhtml"><div>c <title>in</title> <b>d</b></div></content></entry><atom:entry><atom:title>X</atom:title></atom:entry></feed>"""
    assert fields(atom, "title", "link", "published", "updated") == [("T <i>", "a?x=1&y=2", "p", "u"), ("X", None, None, None)]
    assert fields(atom)[0][1] == "<div>c <title>in</title> <b>d</b></div>"
    assert fields('<rdf:RDF><channel><title>F</title><items/></channel><item rdf:about="x"><title>R</title><link>l</link></item></rdf:RDF>') == [("R", None, "l")]


def test_damage_costs_what_it_touches():
    a, b = "<item><title>a</title><link>la</link></item>", "<item><title>b</title><link>lb</link></item>"
    whole = [("a", None, "la"), ("x", "s", "lx"), ("b", None, "lb")]
    frames = ["<rss><channel>%s%s%s</channel></rss>", "<rss><channel>%s%s%s"]
    for damaged, own in (
        ("<item><title>x</title><link>lx</link><description>s</description></item>", None), ("<item><title>x<link>lx</link><description>s</description></item>", None), ("<item><title>x</title><link>lx</link><description>s</description>", None),
        ("<item><title>x</title></b><link>lx</link><description>s</item>", None), ("<item><title>x & y < z</title><link>lx</link><description>s</description></item>", ("x & y < z", "s", "lx")),
        ('<item><title>x</title><link>lx</link><description>s</description><a href="></item>', None), ("<item><title>x</title><link>lx</link><description><![CDATA[s]]></description><![CDATA[ </item>", None),
    ):
        for frame in frames:
            assert fields(frame % (a, damaged, b)) == [whole[0], own or whole[1], whole[2]], damaged
    assert fields("<rss><channel>" + a + "<item><title>cut of") == [whole[0], ("cut of", None, None)]
    assert entries(None) == entries("") == entries("no feed < at & all") == [] and len(entries("<item>" * 50)) == 50
