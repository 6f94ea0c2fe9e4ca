"""Hand-written pages in layouts that the maker of labelled pages never makes, with the blocks of their main text."""

LONG = "The river had been rising for three days when the first houses of the lower town were cleared, and by noon on Thursday the bridge was shut to all but the fire crews."
MORE = "Nobody was hurt. The mayor said that the dams upstream had held, although the pumps in the old harbour failed twice in the night."
LAST = "Water levels are expected to fall over the weekend; schools open again on Monday, the council said in a statement."
SIDE = '<a href="/1">Sport</a> <a href="/2">Weather</a> <a href="/3">Jobs</a>'

PAGES = [
    (
        "table layout of old",
        f"""<html><body bgcolor=white><table width=100%><tr><td colspan=2 class=logo><img src=l.gif> Harbour Times</td></tr><tr><td class=leftnav width=140><a href=/>Home</a><br><a href=/n>News</a><br><a href=/s>Sport</a></td>
<td class=content><h1>Flood closes the bridge</h1><p>{LONG}<p>{MORE}<p>{LAST}</td></tr><tr><td colspan=2 class=footer>Copyright 1999 Harbour Times</td></tr></table></body></html>""",
        ["Flood closes the bridge", LONG, MORE, LAST],
    ),
    (
        "journal of many wrappers",
        f"""<!doctype html><body><div id="site"><div class="topbar"><div class="inner">{SIDE}</div></div><div class="layout"><div class="col"><div class="post-body"><h2>Flood closes the bridge</h2><div><div><p>{LONG}</p></div><div><p>{MORE}</p><blockquote>{LAST}</blockquote></div></div></div></div>
<div class="sidebar-right"><div class="widget"><h4>Most read</h4><ol><li><a href=/a>Ten walks</a><li><a href=/b>Two cakes</a></ol></div></div></div><div class="site-footer"><ul><li><a href=/t>Terms</a></li><li><a href=/p>Privacy</a></li></ul></div></div>""",
        ["Flood closes the bridge", LONG, MORE, LAST],
    ),
    (
        "manual with contents and code",
        f"""<html><head><meta charset=utf-8><title>Manual<body></title></head><body><nav class="toc"><ul><li><a href="#a">Start</a><li><a href="#b">Set up</a></ul></nav><main><h1>Set up</h1><p>{LONG}</p><pre>make all
make check</pre><dl><dt>quiet</dt><dd>{MORE}</dd></dl><table><tr><th>Flag<td>Meaning of the flag<tr><th>-q<td>No output at all</table></main><footer>Made by many hands</footer>""",
        ["Set up", LONG, "make all make check", "quiet", MORE, "Flag", "Meaning of the flag", "-q", "No output at all"],
    ),
    (
        "article with what does not belong in it",
        f"""<body><header class=masthead><h1>Harbour Times</h1></header><article itemscope><header><h1>Flood closes the bridge</h1></header><p>{LONG}<button>Share <div>this</div></button></p><div class="ad-slot advert">Buy two boats and get the third one free, only this week and only here.</div><p>{MORE}</p><svg><text>logo</text></svg><object data=x><p>no plug-in</object>
<p>{LAST}</p><div class="newsletter-signup"><p>Get our letter every morning at seven.</p><form><input name=m></form></div></article><section id="comments"><h3>3 comments</h3><article class="comment"><p>I was there and it was much worse than the paper says it was.</p></article></section>""",
        ["Flood closes the bridge", LONG, MORE, LAST],
    ),
    (
        "page of single lines and formulas",
        f"""<html><body><div role="banner">Harbour Times</div><div role="main"><h1>Falling water</h1><p>The level is <math><mi>h</mi><mo>=</mo><mn>3</mn></math> metres, and then it falls.</p>{LONG}<br>{MORE}<h2>Later</h2>{LAST}</div><div role="contentinfo">Imprint &middot; Contact</div>""",
        ["Falling water", "The level is h=3 metres, and then it falls.", f"{LONG} {MORE}", "Later", LAST],
    ),
    (
        "front matter in sections",
        f"""<body class="page"><div class="cookie-consent-bar" id=cc><p>We use cookies to make this page better for you and for our partners.</p><a href=#>Accept</a></div><section class="hero-nav">{SIDE}</section><section class="story"><h1>Flood closes the bridge</h1><p>{LONG}</p><ul><li>{MORE}</li><li>{LAST}</li></ul></section><section class="related-stories"><h2>More like this</h2><p>The old harbour in pictures, from the first stone to the last.</p></section>""",
        ["Flood closes the bridge", LONG, MORE, LAST],
    ),
]
