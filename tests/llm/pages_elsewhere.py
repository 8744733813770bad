"""Pages written by hand after common kinds of sites, none of them made by the training layouts, with their main text."""

PAGES = {
    "recipe": (
        """<!doctype html><html><head><title>Rye bread - Kitchen Notes</title><link rel=stylesheet href=s.css></head><body class="single">
<a class="skip-link" href="#main">Skip to content</a>
<header class="masthead"><a href="/">Kitchen Notes</a><nav aria-label="primary"><a href="/recipes">Recipes</a> <a href="/about">About</a></nav></header>
<div id="cookie-consent" role="dialog"><p>We use cookies to make this site work.</p><button>Accept</button></div>
<main id="main"><article><h1>Dark rye bread in two days</h1>
<p>This loaf needs patience, but hardly any work. Start on Friday evening &mdash; bake on Sunday.</p>
<h2>Ingredients</h2><ul><li>500 g rye flour<li>12 g salt<li>400 ml water, lukewarm</ul>
<h2>Method</h2><ol><li>Mix the starter with half of the flour.</li><li>Wait for twelve hours.</li></ol>
<p>Bake at 230&nbsp;&deg;C for twenty minutes, then at 180.</p></article></main>
<aside class="sidebar"><h3>Popular posts</h3><ul><li><a href="/p1">Soup for a week</a></li><li><a href="/p2">My knives</a></li></ul></aside>
<footer class="site-footer"><p>&copy; 2021 Kitchen Notes. All rights reserved.</p></footer></body></html>""",
        ["Dark rye bread in two days", "This loaf needs patience, but hardly any work. Start on Friday evening — bake on Sunday.", "Ingredients", "500 g rye flour", "12 g salt", "400 ml water, lukewarm", "Method", "Mix the starter with half of the flour.", "Wait for twelve hours.", "Bake at 230 °C for twenty minutes, then at 180."],
    ),
    "news": (
        """<html><body><div class="topbar"><ul class="nav"><li><a href="/world">World</a></li><li><a href="/sport">Sport</a></li></ul></div>
<div class="page"><div class="article-body"><h1 class="headline">Bridge closes for repairs until autumn</h1>
<p>The old bridge over the river will be closed from Monday, the council said.</p>
<div class="advertisement"><p>Sponsored: try our new insurance today.</p></div>
<p>Drivers are asked to use the <a href="/map">northern road</a> instead. Buses will run every ten minutes.</p>
<blockquote><p>"We could not wait any longer," said the engineer in charge.</p></blockquote>
<p>The work is expected to cost two million.</p></div>
<div class="newsletter-signup"><form action="/s"><label>Your e-mail</label><input name=e><button>Subscribe</button></form></div>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>About time, if you ask me.</p></div><div class="comment"><p>Which buses, exactly?</p></div></section></div>
<div id="footer"><p>Copyright 2019 The Valley Paper | <a href="/terms">Terms</a></p></div></body></html>""",
        ["Bridge closes for repairs until autumn", "The old bridge over the river will be closed from Monday, the council said.", "Drivers are asked to use the northern road instead. Buses will run every ten minutes.", '"We could not wait any longer," said the engineer in charge.', "The work is expected to cost two million."],
    ),
    "manual": (
        """<!DOCTYPE html><html lang=en><head><script>window.dataLayer=[];</script></head><body>
<nav class="wy-nav-side"><ul><li><a href="a.html">Install</a></li><li><a href="b.html">Configure</a></li><li><a href="c.html">Troubleshooting</a></li></ul></nav>
<section class="wy-nav-content-wrap"><div role="navigation" aria-label="breadcrumbs"><ul><li><a href="/">Docs</a></li><li>Configure</li></ul></div>
<div role="main" class="document"><div class="section"><h1>Configure the server</h1>
<p>The server reads one file when it starts. Every line holds a name and a value.</p>
<pre>port = 8080
  host = localhost</pre>
<p>Lines that begin with a hash are ignored, so you can leave notes there.</p>
<dl><dt>port</dt><dd>The number of the port, 8080 if it is missing.</dd></dl></div></div>
<footer><div class="rst-footer-buttons"><a href="a.html">Previous</a> <a href="c.html">Next</a></div><p>Built with care.</p></footer></section></body></html>""",
        ["Configure the server", "The server reads one file when it starts. Every line holds a name and a value.", "port = 8080 host = localhost", "Lines that begin with a hash are ignored, so you can leave notes there.", "port", "The number of the port, 8080 if it is missing."],
    ),
    "old tables": (
        """<HTML><BODY BGCOLOR=white><TABLE><TR><TD CLASS=header>The Model Railway Club</TD></TR>
<TR><TD><UL><LI><A HREF=home.htm>Home</A><LI><A HREF=pics.htm>Pictures</A></UL></TD>
<TD><H2>Building a small station</H2><P>Begin with a plan on paper. Measure the space twice, since wood is hard to lengthen.
<P>Glue the platform last; the track must lie <I>flat</I> before that.</TD></TR>
<TR><TD CLASS=footer>Copyright 1999 by the club</TD></TR></TABLE></BODY></HTML>""",
        ["Building a small station", "Begin with a plan on paper. Measure the space twice, since wood is hard to lengthen.", "Glue the platform last; the track must lie flat before that."],
    ),
    "nothing named": (
        """<!doctype html><body><div class="x1a9"><div class="x2"><a href="/">Home</a> <a href="/blog">Blog</a> <a href="/shop">Shop</a></div>
<div class="x77"><h1>What I learned from ten years of beekeeping</h1><p>Bees do not read books. Whatever the manual says, the hive decides.</p>
<p>In the first year I opened the boxes far too often, and the colony moved out in June.</p><p>Now I look twice a month, with a cup of tea, and take notes.</p></div></div>
<footer>© Anna, 2018</footer></body>""",
        ["What I learned from ten years of beekeeping", "Bees do not read books. Whatever the manual says, the hive decides.", "In the first year I opened the boxes far too often, and the colony moved out in June.", "Now I look twice a month, with a cup of tea, and take notes."],
    ),
    "weblog": (
        """<html><body><div id="wrapper"><div id="header"><div id="branding">Late Trains</div><div id="access"><ul class="menu"><li><a href="/">Start</a></li><li><a href="/archive">Archive</a></li></ul></div></div>
<div id="container"><div id="content" role="main"><div id="post-381" class="post-381 post hentry"><h1 class="entry-title">Night train to the coast</h1>
<div class="entry-content"><p>The compartment smelled of oranges. A child was asleep across three seats.</p><p>We reached the sea at six, under a sky like wet slate.</p></div></div>
<div id="disqus_thread"><p>Lovely, thank you for writing this.</p></div></div></div>
<div id="secondary" class="widget-area"><ul><li class="widget widget_search"><form><label>Search for:</label><input type=text></form></li><li class="widget"><h3>Recent posts</h3><ul><li><a href="/1">Delays</a></li></ul></li></ul></div>
<div id="colophon"><p>Proudly powered by a small computer.</p></div></div></body></html>""",
        ["Night train to the coast", "The compartment smelled of oranges. A child was asleep across three seats.", "We reached the sea at six, under a sky like wet slate."],
    ),
}
