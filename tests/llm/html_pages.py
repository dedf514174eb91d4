"""Pages written by hand in layouts of the web, none from the generator: (page, its article's blocks)."""

A = "The council agreed on Tuesday to rebuild the old harbour wall, which lost forty metres of stone in the January storm and has been fenced off since."
B = "Work is to begin in spring and will take eighteen months. Boats can use the eastern basin in the meantime, the harbour master said, though larger ones must wait for high water."
C = "Money comes from three sources: the region, a levy on moorings and a loan that the town will pay back over twenty years, with interest fixed at two percent."
D = "Older residents remember the last rebuilding, in 1961, when divers set the blocks by hand and a crane tipped into the bay without anyone being hurt."
H = "Harbour wall to be rebuilt"
P = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
ABC = [A, B, C]

PAGES = [
    # an encyclopedia: side menu, tool links, category links, closing lines
    (
        f'<body class="skin"><div id="content"><h1 id="firstHeading">{H}</h1><div id="bodyContent"><p>{A}</p><p>{B}</p><h2>History</h2><p>{D}</p></div><div id="catlinks">Categories: <a href=1>Harbours</a> | <a href=2>Walls</a> | <a href=3>Rebuilt structures</a></div></div>'
        '<div id="mw-panel"><div><h3>Navigation</h3><ul><li><a href=a>Main page</a></li><li><a href=b>Contents</a></li><li><a href=c>Random page</a></li></ul></div><div><h3>Tools</h3><ul><li><a href=d>What links here</a></li><li><a href=e>Cite this page</a></li></ul></div></div>'
        '<div id="foot"><ul><li>This page was last edited on 3 May 2021.</li><li>Text is available under a free licence; additional terms may apply.</li></ul><ul><li><a href=p>Privacy policy</a></li><li><a href=q>About</a></li></ul></div></body>',
        [H, A, B, "History", D],
    ),
    # a cookie bar with a name on no list
    (f'<body><div id="gdpr-bar">This website uses cookies to give you the best experience. <a href=/c>Learn more</a> <button>OK</button></div><div id="page"><div class="txt"><h1>{H}</h1>{P}</div></div></body>', [H, *ABC]),
    # hashed class names all over, top menu, links within the article, closing line
    (
        f'<body><div class="css-1q2w3e"><div class="css-9f8e7d"><a class="sc-ab12" href=/>Home</a><a class="sc-ab12" href=/n>News</a><a class="sc-ab12" href=/s>Sport</a><a class="sc-ab12" href=/w>Weather</a></div><div class="css-77aa1b"><h1 class="sc-h1x">{H}</h1><p class="css-p0">{A}</p>'
        f'<p class="css-p0">{B}</p><div class="css-00ff1c">Read also: <a href=/x>Ferry strike enters its second week</a></div><p class="css-p0">{C}</p></div><div class="css-5d5d5d">© 2023 Coast Media Group. All rights reserved.</div></div></body>',
        [H, *ABC],
    ),
    # bare divs without any names
    (f"<body><div><a href=/>Start</a> | <a href=/a>Archive</a> | <a href=/b>Contact</a></div><div><h1>{H}</h1>{P}</div><div><ul><li><a href=1>Bridge closed</a></li><li><a href=2>New ferry</a></li><li><a href=3>Tide tables</a></li></ul></div><div>Copyright 2019 The Bay Paper</div></body>", [H, *ABC]),
    # section elements with plain names
    (f'<body><header class="hd"><a href=/>The Bay Paper</a></header><section class="lead"><h1>{H}</h1>{P}</section><section class="strip"><h2>Trending</h2><ul><li><a href=1>Ten walks</a></li><li><a href=2>Five soups</a></li><li><a href=3>Two boats</a></li></ul></section></body>', [H, *ABC]),
    # nested wrappers
    (f'<body><div class="a"><div class="b"><div class="c"><div class="nav-x"><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div><div class="d"><div class="e"><h1>{H}</h1>{P}<p>{D}</p></div></div></div></div></div></body>', [H, *ABC, D]),
    # a newsletter box in the middle of the article
    (f'<body><main><h1>{H}</h1><p>{A}</p><div class="nl-box"><p>Subscribe to our newsletter and never miss a story.</p><form><input><button>Join</button></form></div><p>{B}</p><p>{C}</p></main></body>', [H, *ABC]),
    # blog with tags and neighbours
    (f'<body><div id="wrap"><div class="hentry"><h2>{H}</h2>{P}<div class="post-tags"><a href=1>harbour</a> <a href=2>storm</a> <a href=3>council</a></div></div><div class="prevnext"><a href=p>Older: A winter walk along the shore</a> <a href=n>Newer: Spring at last</a></div><div id="r-col"><h4>Blogroll</h4><ul><li><a href=1>Sea notes</a></li><li><a href=2>Tide and time</a></li></ul></div></div></body>', [H, *ABC]),
    # German, imprint below
    (
        "<body><div class=kopf><ul><li><a href=1>Startseite</a></li><li><a href=2>Politik</a></li><li><a href=3>Wirtschaft</a></li></ul></div><div class=inhalt><h1>Der Hafen wird neu gebaut</h1><p>Der Rat hat am Dienstag beschlossen, die alte Mauer am Hafen zu erneuern, die im Januar auf vierzig Metern eingestürzt war.</p><p>Die Arbeiten beginnen im Frühjahr und dauern anderthalb Jahre, sagte der Hafenmeister, größere Schiffe müssen auf Hochwasser warten.</p></div>"
        "<div class=fuss>Alle Rechte vorbehalten. <a href=i>Impressum</a> <a href=d>Datenschutz</a></div></body>",
        ["Der Hafen wird neu gebaut", "Der Rat hat am Dienstag beschlossen, die alte Mauer am Hafen zu erneuern, die im Januar auf vierzig Metern eingestürzt war.", "Die Arbeiten beginnen im Frühjahr und dauern anderthalb Jahre, sagte der Hafenmeister, größere Schiffe müssen auf Hochwasser warten."],
    ),
    # a table layout
    (f"<body><table><tr><td><a href=1>Home</a><br><a href=2>Guestbook</a><br><a href=3>Links</a></td><td><h1>{H}</h1>{P}</td></tr><tr><td></td><td>Last changed 4 March 2003, webmaster</td></tr></table></body>", [H, *ABC]),
    # documentation with contents at the side
    (f'<body><div class="toc-x"><ul><li><a href=1>Install</a><ul><li><a href=2>Linux</a></li><li><a href=3>Others</a></li></ul></li><li><a href=4>Use</a></li></ul></div><div role="main"><h1>Install</h1><p>Unpack the archive into a folder of its own, and call the script with the name of the folder that is to hold the tables.</p><pre>unpack tables.tar into /srv/tables</pre><p>The first call takes some minutes, as it reads all the tables once and writes down where each begins.</p></div></body>', ["Install", "Unpack the archive into a folder of its own, and call the script with the name of the folder that is to hold the tables.", "unpack tables.tar into /srv/tables", "The first call takes some minutes, as it reads all the tables once and writes down where each begins."]),
    # article with list and quotation
    (f'<body><nav><a href=/>x</a></nav><article><h1>{H}</h1><p>{A}</p><ul><li>Work starts in April, once the birds have nested.</li><li>The eastern basin stays open for small boats.</li></ul><blockquote>We waited long enough, said one of the fishermen.</blockquote><p>{C}</p></article><aside><p>Follow us for more.</p></aside></body>', [H, A, "Work starts in April, once the birds have nested.", "The eastern basin stays open for small boats.", "We waited long enough, said one of the fishermen.", C]),
    # comments below
    (f'<body><div class="story-x"><h1>{H}</h1>{P}</div><div id="comments"><h3>3 comments</h3><div class="comment"><p>About time, it has been a mess for years and nobody cared.</p></div><div class="comment"><p>And who pays? We do, as always, with our taxes and fees.</p></div></div></body>', [H, *ABC]),
    # one long paragraph only
    (f"<body><div class=m><a href=1>Home</a> <a href=2>About</a></div><p>{A} {B} {C} {D}</p></body>", [f"{A} {B} {C} {D}"]),
    # text in divs with breaks
    (f"<body><div class=top><a href=1>Home</a> <a href=2>Poems</a> <a href=3>Mail</a></div><div class=t>{A}<br><br>{B}<br><br>{C}</div><div class=end><a href=1>Back</a></div></body>", [f"{A} {B} {C}"]),
    # a long footer of link columns
    (f'<body><div class="w"><h1>{H}</h1>{P}</div><div class="ft"><div><h4>Company</h4><ul><li><a href=1>About us</a></li><li><a href=2>Jobs</a></li></ul></div><div><h4>Help</h4><ul><li><a href=3>Contact</a></li><li><a href=4>Delivery</a></li></ul></div><p>© 2020 Coast Media. Registered in the bay.</p></div></body>', [H, *ABC]),
    # share bar and related stories within the article element
    (f'<body><article><h1>{H}</h1><div class="sb"><a href=1>Tweet</a> <a href=2>Mail</a> <a href=3>Print</a></div>{P}<div class="rl"><h3>More on this</h3><ul><li><a href=1>Storm damage worse than thought</a></li><li><a href=2>Council meets in tent</a></li></ul></div></article></body>', [H, *ABC]),
    # a notice about the site's terms, above all else
    (f'<body><div class="x1"><p>By using this site you accept our privacy policy.</p></div><div class="x2"><h1>{H}</h1>{P}<p>{D}</p></div></body>', [H, *ABC, D]),
    # an article about cookies and copyright stays
    ("<body><nav><ul><li><a href=1>Law</a></li><li><a href=2>Trade</a></li></ul></nav><article><h1>Court rules on cookies</h1><p>The court held on Friday that consent to cookies must be given freely, and that a box ticked in advance does not count as consent under the privacy rules.</p><p>Copyright was not at issue, the judges wrote, although both sides had argued about it for most of the hearing.</p></article></body>", ["Court rules on cookies", "The court held on Friday that consent to cookies must be given freely, and that a box ticked in advance does not count as consent under the privacy rules.", "Copyright was not at issue, the judges wrote, although both sides had argued about it for most of the hearing."]),
    # hashed names, cookie bar at the end
    (f'<body><div class="jsx-11"><div class="jsx-22"><ul class="jsx-3"><li><a href=1>World</a></li><li><a href=2>Money</a></li><li><a href=3>Culture</a></li></ul></div><div class="jsx-44"><div class="jsx-55"><h1 class="jsx-6">{H}</h1><p class="jsx-7">{A}</p><p class="jsx-7">{B}</p><p class="jsx-7">{D}</p></div></div></div><div class="jsx-88"><div class="jsx-9">We use cookies and similar tools.</div><button>Accept</button></div></body>', [H, A, B, D]),
]

#: Written after the generator and the features were settled, and not looked at for them.
S1 = "Three of the five wells in the upper village have run dry since August, and the two that remain give water the colour of weak tea."
S2 = "A geologist from the provincial office came on Wednesday, lowered a line into each shaft and wrote down depths that nobody had seen in forty years of records."
S3 = "Until rain comes, a tanker will stop at the school twice a day; every household may fill four cans, and the sick are served first."
T = "Wells fail in the upper village"
HELD_OUT = [
    (f'<body><div id="mast"><a href=/>Valley Post</a></div><div id="strip"><ul><li><a href=1>Local</a></li><li><a href=2>Letters</a></li><li><a href=3>Obituaries</a></li></ul></div><div id="col1"><h1>{T}</h1><div class="byl">By our correspondent</div><p>{S1}</p><p>{S2}</p><p>{S3}</p></div><div id="col2"><h4>Weather</h4><p>Dry, 31 degrees.</p><h4>Also today</h4><ul><li><a href=4>Bus fares rise</a></li><li><a href=5>Choir wins cup</a></li></ul></div><div id="base">Valley Post Ltd, Mill Lane. <a href=6>Terms</a> <a href=7>Contact</a></div></body>',[T,"By our correspondent",S1,S2,S3]),
    (f'<body><div class="k9x2"><div class="p3v8">Your privacy matters. We and our partners store data. <a href=c>Manage</a></div><div class="z7t1"><div class="z7t2"><h1>{T}</h1><p>{S1}</p><div class="q1q1"><a href=r>Read more: What to do when the tap runs dry</a></div><p>{S2}</p><p>{S3}</p></div></div><div class="m4m4"><a href=1>About</a><a href=2>Help</a><a href=3>Jobs</a><span>© Valley Post</span></div></div></body>',[T,S1,S2,S3]),
    (f'<body><main><nav><ol><li><a href=/>Home</a></li><li><a href=/v>Village</a></li></ol></nav><h1>{T}</h1><p>{S1} <a href=m>See the map</a> of all shafts.</p><h2>What was measured</h2><p>{S2}</p><ul><li>North well: 41 metres</li><li>Church well: 44 metres</li></ul><p>{S3}</p><footer><p>Filed under <a href=t>water</a>, <a href=u>drought</a></p></footer></main></body>',[T,f"{S1} See the map of all shafts.","What was measured",S2,"North well: 41 metres","Church well: 44 metres",S3]),
    (f'<body><table width=100%><tr><td colspan=2><a href=1>Index</a> - <a href=2>Search</a> - <a href=3>Help</a></td></tr><tr><td><b>Sections</b><br><a href=4>Farm</a><br><a href=5>Market</a></td><td><h2>{T}</h2>{S1}<p>{S2}<p>{S3}</td></tr></table><center>(c) 1999 Valley Post</center></body>',[T,S1,S2,S3]),
    (f'<body><div class="app"><div class="hero"><h1>{T}</h1></div><div class="rich-text"><p>{S1}</p><p>{S2}</p><p>{S3}</p></div><div class="cards"><div class="card"><a href=1><h3>Rain at last</h3></a><p>Clouds gathered over the ridge.</p></div><div class="card"><a href=2><h3>School reopens</h3></a><p>Pupils return on Monday.</p></div></div><div class="subscribe-cta"><p>Get the morning letter in your inbox.</p></div></div></body>',[T,S1,S2,S3]),
]
