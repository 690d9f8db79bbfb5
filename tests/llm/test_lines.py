"""Repeated lines, and bodies of pages."""

import random
import re

from loamworks.llm import boilerplate as B
from loamworks.llm import lookalike as L
from loamworks.llm import repeated_lines as R

SCHEMA = "result_id long, url string, raw_text string, rec string, site string, page string, text string, _k string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


def brute(rows, pages=8):
    seen, where = {}, []
    for rec, url, text in rows:
        if not text or url is None:
            continue
        host, path = re.match(r"(?:\w+://)?([^/?#]*)([^?#]*)", url).groups()
        site = re.sub(r"^www\.", "", host.lower().split(":")[0])
        for k, line in enumerate(text.split("\n")):
            key = "".join(c for c in L.canonical_text(line).casefold() if c.isalpha())
            if key:
                seen.setdefault((site, key), set()).add(path.rstrip("/"))
                where.append((rec, k, (site, key)))
    return {(r, k) for r, k, x in where if len(seen[x]) >= pages}


def test_repeated_lines(spark):
    long = "A long legal notice that goes on and on, " * 40
    rows = [(i, f"http://www.a.example:80/p{i}?x={i}", f"Page {i} xyz\nSHARE this  {i}!\r\n\n123\n{long}\nStraße\nlast") for i in range(8)]
    rows += [(100 + i, "http://a.example/p1/", "only here often") for i in range(20)] + [(200, None, "Share this"), (201, "http://a.example/q", None), (202, "http://a.example/q", ""), (203, "http://b.example/q", "Share this"), (204, "http://a.example/q9", "share-this\nSTRASSE")]
    got = R.repeated_lines(table(spark, rows)).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(set(map(tuple, got)))
    assert (204, 0) in brute(rows) and (204, 1) in brute(rows)
    assert R.repeated_lines(table(spark, [])).count() == 0


def test_chunks_do_not_depend_on_place():
    r = random.Random(5)
    line = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(1500))
    whole, chunks = R.line_hashes([line])[0]
    assert R.line_hashes(["before", "", line.upper(), "after"])[2] == (whole, chunks)
    assert len(chunks) > 20 and whole not in chunks
    assert R.line_hashes(["1 2 3", "", "½"])[0] is None
    # newlines are no cuts: most chunks of two halves are those of the whole, and none is new but near the break
    half = len(line) // 2
    halves = [c for h in R.line_hashes([line[:half], line[half:]]) for c in h[1]]
    assert set(halves) <= set(chunks) and len(halves) >= len(chunks) - 2


def test_lines_settled_by_chunks(spark):
    """Long lines that few pages hold are settled by their chunks; those that share some chunks with repeated ones are counted whole."""
    words = lambda i, n=300: " ".join("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(1)) + " " + " ".join("".join(random.Random(i * 1000 + k).choices("abcdefghijklmnopqrstuvwxyz", k=5)) for k in range(n))
    common = words(1)
    rows = [(i, f"http://a.example/{i}", f"{common}\n{words(100 + i)}\n{common} and {words(200 + i, 50)}\nshort {i % 2 * 'x'}") for i in range(9)]
    got = {tuple(r) for r in R.repeated_lines(table(spark, rows)).collect()}
    assert got == brute(rows) == {(i, 0) for i in range(9)}
    assert {tuple(r) for r in R.repeated_lines(table(spark, rows), pages=4).collect()} == brute(rows, 4)


def test_repeated_lines_on_the_tables(spark, small):
    df = spark.read.parquet(f"{small}/scraping_result.parquet")
    rows = [tuple(r) for r in df.select("result_id", "url", "raw_text").collect()]
    assert {tuple(r) for r in R.repeated_lines(df, pages=3).collect()} == brute(rows, 3)


def test_removal_keeps_all_else(spark):
    df = table(spark, [(1, "u", "a\r\nb\nc"), (2, "u", None), (3, "u", "x")])
    lines = spark.createDataFrame([(1, 1)], "result_id long, line_no int")
    got = {r["result_id"]: r["kept_text"] for r in R.without_lines(df, lines).collect()}
    assert got == {1: "a\r\nc", 2: None, 3: "x"}


PAGE = """Basket | Log in | Blog
We set cookies to measure traffic. Read more in our notice.
Accept all
Locations / Pelaladapu

Pelaladapu terms, in plain words
By Raúl Fenguzon
The page on cookies at Pelaladapu took longest to write, since the bakery sells 41 kinds of cookies and the law means another kind.
- Pelaladapu tile glaze, 57 pieces
Share this text
Most read this week
A day at Godupegida
How Mopabebapa ships clinic chairs
Nobody expected the stock count to be this brisk, yet the pattern held for 46 months.
Receive new pages by mail; leave whenever you like.
(c) 2025 Dratentzki Tools. All rights reserved.
Dratentzki Tools, 41 Saddler Terrace, Copperdown QV9 4ZW
Back to top"""
BOILERPLATE = {0, 1, 2, 3, 9, 10, 11, 12, 14, 15, 16, 17}


def test_page_body(spark):
    rows = [(1, "https://tools-x.example/people/pelaladapu-34", PAGE), (2, None, "Back to top\nSome text of its own"), (3, "u", None), (4, "u", ""), (5, "u", "\n \n")]
    got = {}
    for r in B.boilerplate_lines(table(spark, rows)).collect():
        got.setdefault(r["result_id"], set()).add(r["line_no"])
    assert got == {1: BOILERPLATE, 2: {0}}
    assert B.boilerplate_lines(table(spark, [])).count() == 0


def test_pages_of_a_host_decide_together(spark):
    """A firm's address is known where its name stands; other pages of the host learn it by vote."""
    address = "Dratentzki Tools, 41 Saddler Terrace, Copperdown QV9 4ZW"
    texts = ["The river stayed low", "Nobody had seen it", "It rained at last", "We walked home", "Boats lay on the bank", "The wheel was turned"]  # alike lines that differ by a number would be one path
    rows = [(i, f"https://shop.example/p/a{i}", f"{texts[i]}.\n{address}\n" + ("(c) 2025 Dratentzki Tools. All rights reserved." if i else "")) for i in range(6)]
    got = {tuple(r) for r in B.boilerplate_lines(table(spark, rows)).collect()}
    assert (0, 1) in got and (3, 1) in got
    assert not any(k == 0 for _, k in got)


def test_long_lines(spark):
    rows = [(1, "http://a.example/x", "w " * 500_000 + "\nBack to top")]
    assert {tuple(r) for r in B.boilerplate_lines(table(spark, rows)).collect()} == {(1, 1)}
    assert R.repeated_lines(table(spark, rows), pages=1).count() == 2


def test_a_host_lifts_its_notices(spark):
    """What a host's pages repeat is its frame without any cue, at the foot and amid the text; other hosts learn it from there."""
    notice = "The mill cannot be held to anything that its readers may conclude from these columns."
    body = ["The {} wheel was turned by hand for as long as the river stayed low.", "How flour ships", "Nobody on the {} side of the bank had seen the water rise so fast."]
    words = "old new red blue tall wide thin calm dark late".split()
    rows = [(i, f"http://mill.example/{w}-story", "\n".join([*(x.format(w) for x in body), "All of it was {} by then, and we all walked home along the bank.".format(w), notice])) for i, w in enumerate(words)]
    rows += [(51, "http://rare.example/b", "Elsewhere\nHow flour ships")]
    got = {tuple(r) for r in B.boilerplate_lines(table(spark, rows)).collect()}
    assert got == {(i, k) for i in range(10) for k in (1, 4)} | {(51, 1)}


SYLLABLES = "bo da fe gi ku la mo ne pi ru sa te vo zu".split()


def invented(r, n):
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(2, 3))) for _ in range(n))


def invented_hosts(hosts=20, pages=15, seed=1):
    """Pages of words of no language, so that no list can hold them: menus, notices at the foot and amid the text, teasers; bodies; bylines."""
    r = random.Random(seed)
    rows, truth, n = [], set(), 0
    for h in range(hosts):
        menu = [invented(r, 1).capitalize() for _ in range(5)]
        notices = [invented(r, r.randint(7, 16)).capitalize() + "." for _ in range(5)]
        teaser = invented(r, 3)
        authors = [invented(r, 2).title() for _ in range(3)]
        for p in range(pages):
            subject = invented(r, 1).replace(" ", "") + "xo"
            lines = [(x, True) for x in menu]
            lines += [(f"{invented(r, 2).capitalize()} {subject}", False), (f"Wu {r.choice(authors)}", False)]
            text = [(invented(r, r.randint(20, 60)).capitalize() + ".", False) for _ in range(r.randint(2, 6))]
            text.insert(r.randint(1, len(text)), (notices[p % 3], True))
            lines += text + [(f"{invented(r, 1).capitalize()} {teaser}", True), (f"{invented(r, 1).capitalize()} {teaser}", True), (notices[3], True), (notices[4], True)]
            rows.append((n, f"http://h{h}.example/zo/{subject}-{p}", "\n".join(x for x, _ in lines)))
            truth |= {(n, k) for k, (_, b) in enumerate(lines) if b}
            n += 1
    return rows, truth


def test_hosts_whose_words_no_list_holds(spark):
    rows, truth = invented_hosts()
    got = {tuple(r) for r in B.boilerplate_lines(table(spark, rows)).collect()}
    both = len(got & truth)
    assert both >= 0.95 * len(truth) and both >= 0.95 * len(got), (both, len(truth), len(got))


def test_a_body_line_with_a_cue_is_kept(spark):
    """A cue only seeds the vote: on a host with pages enough, what one page alone says amid its text is body."""
    rows, truth = invented_hosts(hosts=1, pages=30)
    said = "All rights reserved, said the sign."
    rec, url, text = rows[4]
    lines = text.split("\n")
    at = next(k for k in range(len(lines) - 1) if (4, k) not in truth and (4, k + 1) not in truth and len(lines[k]) > 60 and len(lines[k + 1]) > 60) + 1
    rows[4] = (rec, url, "\n".join([*lines[:at], said, *lines[at:]]))
    got = {k for r, k in map(tuple, B.boilerplate_lines(table(spark, rows)).collect()) if r == 4}
    assert at not in got
    alone = {tuple(r) for r in B.boilerplate_lines(table(spark, [(1, "http://one.example/x", "All rights reserved.")])).collect()}
    assert alone == {(1, 0)}


def test_blocks_of_html(spark):
    rows, _ = invented_hosts(hosts=2, pages=8)
    pages = []
    for rec, url, text in rows:
        lines = text.split("\n")
        menu = "".join(f"<li class='i{k}'><a href='/'>{x}</a></li>" for k, x in enumerate(lines[:5]))
        pages.append((rec, url, f"<html><head><title>t</title><script>x()</script></head><body><nav><ul>{menu}</ul></nav><article class='post-{rec}'><h1>{lines[5]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[6:-4]) + f"</article><div class='foot'><p>{lines[-2]}</p><p>{lines[-1]}"))
    pages += [(900, "u", None), (901, "u", ""), (902, None, "<p>One & only"), (903, "http://x.example/a", "no tags at all")]
    df = spark.createDataFrame(pages, "id long, url string, html string")
    got = B.body_blocks(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], {})[r["block_no"]] = r["boilerplate"]
    for rec, _, text in rows:
        n = len(text.split("\n")) - 2
        assert [by[rec][k] for k in range(5)] == [True] * 5 and by[rec][5] is False and [by[rec][n - 2], by[rec][n - 1]] == [True, True], by[rec]
    assert not {900, 901} & by.keys() and len(by[902]) == len(by[903]) == 1
    assert B.body_blocks(df.limit(0)).count() == 0


def test_a_few_pages_of_many_lift_no_subheading(spark):
    rows = [(i, f"http://big.example/{w}-tale", f"The {w} wheel was turned by hand for as long as the river stayed low.\n" + ("Background\n" if i < 4 else "") + f"Nobody on the {w} side of the bank had seen the water rise so fast.") for i, w in enumerate("old new red blue tall wide thin calm dark late loud soft".split())]
    assert B.boilerplate_lines(table(spark, rows)).count() == 0


def test_cues_and_lists_in_long_lines():
    consent = "Marrow Tools sets cookies to measure traffic. By going on you agree to cookies. You can change your choice later under cookie settings. "
    seed = lambda line: B.page_lines("http://a.example/x", [line])[0][2]
    assert seed(consent * 4) > 0
    assert seed(" | ".join(["about us", "basket", "careers", "community", "contact", "documentation"] * 8)) > 2
    assert seed(consent + "The bakery sells many kinds of bread and its owner walks to the mill each day. " * 5) < 0


def test_a_line_is_not_counted_with_longer_ones_that_hold_it(spark):
    words = " ".join("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for i in range(1500))
    letters = words.replace(" ", "")
    heads = [n for n in range(40, 3000) if len(R.line_hashes([letters[:n]])[0][1]) == 1]  # holds the first chunk of the longer line
    assert R.line_hashes([letters[: heads[0]]])[0][1][0] == R.line_hashes([letters])[0][1][0]
    rows = [(i, f"http://a.example/{i}", letters if i < 5 else letters[: heads[0]]) for i in range(8)]
    assert heads and R.repeated_lines(table(spark, rows)).count() == 0


def test_runs_of_chunks_over_line_ends_give_short_lines(spark):
    """Short lines that stand together are found by the chunks that run over their ends, whatever stands around them, and lines broken elsewhere are not taken for them."""
    r = random.Random(11)
    words = lambda n: [invented(r, 2) for _ in range(n)]
    menu = words(60)
    assert all(not h[1] for h in R.line_hashes(menu))  # none of the lines holds a chunk
    letters = lambda lines: R.letter_streams(lines)
    near, far = ([run for _, a, b, run in R.page_runs([letters(words(k) + menu + words(9))])] for k in (3, 40))
    assert len(set(near) & set(far)) > 5
    broken = [" ".join(menu[k : k + 2]) for k in range(1, 59, 2)]  # the same letters with other line ends
    rows = [(i, f"http://a.example/{i}", "\n".join(words(3 + i) + (menu if i < 8 else broken) + words(9))) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", "\n".join(menu)) for i in range(7)] + [(200 + i, "http://c.example/one", "\n".join(menu)) for i in range(9)]
    rows += [(300, "http://a.example/other", f"{menu[30]}\nalone")]
    made = R.line_runs(table(spark, rows), "result_id", "url", "raw_text").cache()
    by_run = [x["by_run"] for x in R.found_lines(made).collect()]
    assert len(by_run) == 60 and sum(by_run) > 40
    for pages in (8, 4, 1):
        assert sorted(map(tuple, R.repeated_lines(table(spark, rows), pages=pages).collect())) == sorted(brute(rows, pages))
    assert (300, 0) in brute(rows) and not any(100 <= k < 300 for k, _ in brute(rows))


def test_runs_against_brute_force(spark):
    """Few distinct lines, short and long, in any order and number, fetched again, on few sites; small chunks."""
    r = random.Random(3)
    pool = [invented(r, r.choice([1, 1, 2, 5, 30])) for _ in range(12)] + ["12", ""]
    rows = [(i, f"http://s{i % 3}.example/{r.randint(1, 14)}", "\n".join(r.choices(pool, k=r.randint(0, 9)))) for i in range(150)]
    for mean, pages in ((4, 8), (16, 8), (64, 9), (16, 2)):
        got = [tuple(x) for x in R.repeated_lines(table(spark, rows), pages=pages, mean=mean).collect()]
        assert sorted(got) == sorted(brute(rows, pages)), (mean, pages)
