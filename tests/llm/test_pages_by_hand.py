"""Pages written by hand, in layouts of many kinds; each block says whether it is of the article.

A block is `+text` (article) or `-text`; the marks go away before the page is read. No page
comes from the generator the network is trained on, and none was used to fit it. (What a first
run got wrong, definition lists and footers without a name, led to more kinds of generated pages.)
"""

import re
import time

import numpy as np
import pytest

from galley.llm import html_lstm

PAGES = [
    # laid out by a table, menu in a list
    "<table><tr><td><ul><li><a href=a>-Home</a><li><a href=b>-News</a><li><a href=c>-Contact</a></ul></td><td><h1>+River levels rise</h1><p>+The river rose two metres overnight and flooded the lower town.</p><p>+Residents were moved to the school.</p></td></tr></table><p>-Copyright 2004 The Gazette</p>",
    # figure, table and list inside main
    "<header><a href=/>-My kitchen</a></header><main><h1>+How to bake bread</h1><p>+Bread needs four things and some patience.</p><figure><img src=b.png><figcaption>+A loaf from our oven</figcaption></figure><table><tr><th>+Item</th><th>+Grams</th></tr><tr><td>+Flour</td><td>+500</td></tr><tr><td>+Water</td><td>+350</td></tr></table><ul><li>+Mix everything</li><li>+Wait one hour</li><li>+Bake at 230 degrees</li></ul><p>+Let it cool before you cut it.</p></main><footer>-Copyright 2020</footer>",
    # cookie bar, share links, comment thread
    "<div class='cookie-bar'>-We use cookies to improve this site. <button>-OK</button></div><nav><a href=/>-Home and News</a></nav><article><h1>+New bridge opens</h1><p>+The mayor opened the new bridge on Sunday in front of a large crowd.</p><p>+It took four years to build.</p><div class='share'><a href=f>-Facebook</a> <a href=t>Twitter</a></div></article><div id='disqus_thread'><h3>-2 comments</h3><div><b>-anna</b><p>-I am glad that it is finally open, well done.</p></div><div><b>-bob</b><p>-Too expensive if you ask me.</p></div></div><footer>-About us</footer>",
    # no article element, old-fashioned names
    "<div id=masthead><h2>-The Daily Note</h2></div><div id=leftnav><a href=1>-World</a><br><a href=2>-Sport</a><br><a href=3>-Culture</a></div><div id=story><h2>+Orchestra plays in the park</h2><p>+Some three thousand people came to hear the city orchestra on Friday evening.</p><p>+The programme had works by two living composers.</p><p>+Entry was free.</p></div><div id=footer><a href=4>-Terms</a> | <a href=5>Privacy</a></div>",
    # headings and quotes
    "<nav><ul><li><a href=1>-Start</a></li><li><a href=2>-Blog</a></li></ul></nav><article><h1>+Why we moved to the coast</h1><h2>+The first winter</h2><p>+It was cold and the roof leaked.</p><blockquote><p>+You will not last a year, said the neighbour.</p></blockquote><h2>+The first summer</h2><p>+We swam every morning and painted the shutters.</p></article><aside><h3>-More stories</h3><a href=3>-Ten hikes near the sea</a></aside><footer><p>-All rights reserved</p></footer>",
    # a form, a newsletter box and an advert between paragraphs
    "<div class=header><a href=/>-Garden post</a></div><form action=/s><label>-Search</label><input name=q><button>-Go</button></form><div class='content'><h1>+Pruning roses</h1><p>+Cut the old wood in late winter, just above a bud that faces outwards.</p><div class='ad'>-Buy our garden gloves today</div><p>+Feed the plants once the first leaves show.</p><div class='newsletter'><p>-Sign up for our weekly letter</p><form><input type=email><button>-Subscribe</button></form></div><p>+Water them in dry weeks.</p></div><div class='footer'>-Garden post, 12 Hill Road</div>",
    # breadcrumbs and related posts
    "<div class=breadcrumbs><a href=1>-Home</a> &gt; <a href=2>Science</a></div><main><h1>+Comet seen over the city</h1><p>+The comet can be seen without a telescope until the end of the month.</p><p>+It will return in eighty years.</p></main><div class='related-posts'><h3>-Read next</h3><ul><li><a href=3>-The moons of Saturn</a></li><li><a href=4>-How far is a light year</a></li></ul></div><footer>-Contact and imprint</footer>",
    # ordered list and code
    "<nav><a href=1>-Docs</a></nav><article><h1>+Install the tool</h1><ol><li>+Download the archive</li><li>+Unpack it</li><li>+Run the setup</li></ol><pre>+tar xf tool.tar\nmake install</pre><p>+You may need to log in again.</p></article><footer>-Version 3 of the manual</footer>",
    # German page, unclosed paragraphs
    "<div id=navigation><ul><li><a href=1>-Startseite</a><li><a href=2>-Verein</a></ul></div><article><h1>+Sommerfest im Dorf</h1><p>+Am Samstag feiert der Verein sein Sommerfest auf der Wiese hinter der Schule.<p>+Es gibt Musik und Kuchen.<p>+Der Eintritt kostet nichts.</article><footer>-Impressum</footer>",
    # comments as list items, with replies
    "<header><h1>-Blog of a baker</h1></header><article><h2>+Sourdough diary</h2><p>+Day three, and the starter smells of apples.</p><p>+I feed it twice a day.</p></article><ul class='commentlist'><li class='comment'><span>-Mia</span> <p>-Mine smelled of socks, give it time.</p></li><li class='comment'><span>-Jon</span> <p>-Use rye flour for the first days.</p></li></ul><footer>-Powered by a small server</footer>",
    # sidebar before the article
    "<aside class=sidebar><h3>-About</h3><p>-I write about trains and stations.</p><h3>-Archive</h3><a href=1>-May</a></aside><article><h1>+Night train to the north</h1><p>+The night train leaves at ten and arrives with the first light.</p><p>+Book a bed if you want to sleep.</p><p>+Breakfast comes in a paper bag.</p></article><footer>-Trains and stations</footer>",
    # data table in an article element
    "<nav><a href=1>-Statistics</a></nav><article><h1>+Rain by month</h1><p>+The table shows rain in millimetres at the harbour.</p><table class=data><tr><th>+Month</th><th>+Rain</th></tr><tr><td>+June</td><td>+61</td></tr><tr><td>+July</td><td>+48</td></tr></table><p>+August was dry.</p></article><footer>-Weather office</footer>",
    # consent box at the end, advert at the top
    "<div class=advertisement>-Cheap flights from the city airport</div><article><h1>+Museum shows early maps</h1><p>+More than two hundred maps are on show, many for the first time.</p><p>+The exhibition ends in March.</p></article><div id=consent><p>-By using this site you accept cookies.</p><button>-Accept all</button></div>",
    # French page in plain divisions
    "<div class=menu><ul><li><a href=1>-Accueil</a></li><li><a href=2>-Recettes</a></li></ul></div><div class=entry-content><h1>+Soupe aux oignons</h1><p>+Coupez les oignons en tranches fines et faites les dorer dans le beurre.</p><p>+Ajoutez le bouillon et laissez cuire une demi-heure.</p></div><div class=footer>-Mentions et contact</div>",
    # social bar above, pager below
    "<header><a href=/>-City news</a></header><article><h1>+Library stays open late</h1><div class='social'><a href=f>-Share</a> <a href=t>Tweet</a></div><p>+From Monday the library stays open until ten in the evening.</p><p>+Students had asked for longer hours.</p></article><div class='pagination'><a href=1>-Previous</a> <a href=2>Next</a></div><footer>-City news office</footer>",
    # a letter to the editor, plain names
    "<div id=top><a href=/>-The valley paper</a></div><div id=left><a href=1>-Front page</a> <a href=2>Letters</a></div><div id=middle><h1>+Too many cars</h1><p>+Sir, I counted four hundred cars in one hour on our small road.</p><p>+Something must be done before somebody is hurt.</p></div><div id=right class=sponsored>-Visit the new furniture house</div><div id=bottom class=footer>-Published weekly</div>",
    # recipe with a list inside a section
    "<nav class=nav><a href=1>-Soups</a> <a href=2>Cakes</a></nav><section class=post><h2>+Plum cake</h2><ul><li>+One kilo of plums</li><li>+Three eggs</li><li>+200 grams of butter</li></ul><p>+Beat the butter with the eggs, add flour and pour it over the plums.</p><p>+Bake it for 40 minutes.</p></section><section class=comments><h3>-Comments</h3><p><b>-Ada:</b> I took cherries and it was fine.</p></section><footer>-Kitchen club</footer>",
    # interview with a picture and a pull quote
    "<header><p>-Radio north</p></header><nav><ul><li><a href=1>-Live</a></li><li><a href=2>-Programme</a></li></ul></nav><main><h1>+The man who repairs organs</h1><figure><img src=o.jpg><figcaption>+In his workshop near the station</figcaption></figure><p>+He began at fifteen and has tuned every organ in the county.</p><blockquote>+An organ is a building that breathes.</blockquote><p>+He does not plan to stop.</p></main><aside class=related><h4>-Also on air</h4><p>-The bell founders of the south</p></aside><footer>-Radio north, house of broadcasting</footer>",
    # sports report, advert named promo, poll form
    "<div class=promo>-Win two tickets for the final</div><article><h1>+Home side wins late</h1><p>+A goal in the last minute decided an even match on a wet pitch.</p><p>+The coach praised his young keeper.</p><p>+The next match is on Sunday at 15:30.</p></article><form><label>-Who was the best player</label><button>-Vote</button></form><div class=footer><p>-Sports desk</p></div>",
    # definition list
    "<nav><a href=1>-Index</a></nav><main><h1>+Words of the sea</h1><dl><dt>+Port</dt><dd>+The left side of a ship when you look ahead</dd><dt>+Starboard</dt><dd>+The right side of a ship</dd></dl><p>+Both words are old.</p></main><footer>-Harbour school</footer>",
]


def labelled(page):
    """The page without its marks, and the blocks with their labels."""
    found = [(t, t[0] == "+") for t, _, _ in html_lstm.blocks(page) if t[0] in "+-"]
    plain = re.sub(r">([+-])(?=\S)", ">", page)
    return plain, [(t[1:], main) for t, main in found]


def test_every_block_is_marked():
    for page in PAGES:
        plain, blocks = labelled(page)
        assert [t for t, _, _ in html_lstm.blocks(plain)] == [t for t, _ in blocks]


def test_blocks_of_hand_written_pages():
    model = html_lstm.trained()
    right = total = whole = 0
    wrong = []
    for page in PAGES:
        plain, blocks = labelled(page)
        p = model.label([html_lstm.vectors(html_lstm.blocks(plain))])[0]
        hits = [(x >= html_lstm.KEEP) == main for x, (_, main) in zip(p, blocks)]
        right, total, whole = right + sum(hits), total + len(hits), whole + all(hits)
        wrong += [t for h, (t, _) in zip(hits, blocks) if not h]
    assert right / total >= 0.97, wrong
    assert whole >= 0.7 * len(PAGES), wrong


def test_forward_pass_equals_a_plain_one():
    """Both directions step by step, without padding or batches."""
    model = html_lstm.trained()
    pages = [html_lstm.vectors(html_lstm.blocks(labelled(p)[0])) for p in PAGES[:5]]
    wf, bf, wb, bb, v, bias = model.theta
    logistic = lambda z: 1 / (1 + np.exp(-z))

    def states(rows, w, b):
        h = c = np.zeros(html_lstm.HIDDEN)
        out = []
        for x in rows:
            i, f, o, g = np.split(np.concatenate([x, h]) @ w + b, 4)
            c = logistic(f) * c + logistic(i) * np.tanh(g)
            h = logistic(o) * np.tanh(c)
            out.append(h)
        return out

    for rows, got in zip(pages, model.label(pages)):
        ahead, back = states(rows, wf, bf), states(rows[::-1], wb, bb)[::-1]
        wanted = [float(logistic(np.concatenate([a, z]) @ v + bias)[0]) for a, z in zip(ahead, back)]
        assert np.allclose(got, wanted, atol=1e-9)


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a \"" * 250_000, "<div>x" * 100_000, "<td>x" * 100_000, "<b>x" * 100_000 + "<p>y" * 1000, "<!" * 300_000, "</i>" * 250_000])
def test_long_and_deep_pages_take_linear_time(page):
    start = time.perf_counter()
    html_lstm.vectors(html_lstm.blocks(page))
    assert time.perf_counter() - start < 20
