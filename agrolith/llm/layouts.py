"""Labelled page layouts: what the main-text model is trained on.

Each layout is a page skeleton. ``{p}`` slots take paragraphs, ``{h}`` headings,
``{s}`` short phrases and ``{l}`` links; elements marked ``data-y`` are main text,
everything else is not. The texts come from sampled pages.
"""

_NAV = '<nav class="menu"><ul>' + "<li>{l}</li>" * 5 + "</ul></nav>"
_COOKIE = '<div class="cookie-notice"><p>We use cookies to improve this site. {s}</p><button>Accept</button></div>'
_COMMENTS = ('<section id="comments" class="comments"><h3>Comments</h3><div class="comment"><p class="author">{s} says:</p><p>{p}</p></div>'
             '<div class="comment"><p>{p}</p><a href="#r">Reply</a></div></section>')
_FORM = '<form action="/subscribe"><label>{s}</label><p>Sign up for our newsletter</p><input type="text"><button>Subscribe</button></form>'
_SIDE = '<aside class="sidebar"><h3>Related</h3><ul><li>{l}</li><li>{l}</li><li>{l}</li></ul><p>{p}</p></aside>'
_FOOT = "<footer><p>&copy; {s}. All rights reserved.</p><ul><li>{l}</li><li>{l}</li></ul></footer>"

LAYOUTS = (
    "<html><head><title>{h}</title></head><body>" + _NAV + '<div class="ad">{p}</div><article><h1 data-y>{h}</h1><p data-y>{p}</p><p data-y>{p}'
    "</p><p data-y>{s}.</p><p data-y>{p}</p></article><footer>&copy; {s} &middot; {p}</footer></body></html>",

    "<html><body><header><h1>{s}</h1><p>{s}</p></header>" + _NAV + '<main><article><header><h1 data-y>{h}</h1></header><p data-y>{p}</p><h2 data-y>{s}'
    "</h2><p data-y>{p}</p><ul><li data-y>{s}</li><li data-y>{p}</li></ul><p data-y>{p}</p>" + _COMMENTS + "</article></main>" + _SIDE + _FOOT + "</body></html>",

    '<html><body><div id="header"><div class="logo">{s}</div><div class="topnav">{l} {l} {l}</div></div><div id="content"><h1 data-y>{h}</h1><div class="text">'
    "<p data-y>{p}</p><p data-y>{p}</p><blockquote data-y>{p}</blockquote><p data-y>{s}.</p></div>" + '<div class="share">{l} {l}</div></div>'
    '<div id="sidebar"><h4>{s}</h4><p>{p}</p><ul><li>{l}</li><li>{l}</li></ul></div><div id="footer">Copyright {s} {l}</div></body></html>',

    "<html><body>" + _COOKIE + _NAV + '<div class="post"><h2 class="entry-title" data-y>{h}</h2><div class="entry-content"><p data-y>{p}</p><p data-y>{p}</p>'
    '<div class="advertisement"><p>{p}</p></div><p data-y>{p}</p><pre data-y>{s}</pre><p data-y>{p}</p></div></div>' + _FORM + _COMMENTS + _FOOT + "</body></html>",

    "<html><body><div>{l} {l} {l} {l}</div><h1 data-y>{h}</h1><p data-y>{p}</p><p data-y>{p}</p><p data-y>{p}</p><p data-y>{p}</p><div>{l} {l}</div>"
    "<p>&copy; {s}</p></body></html>",

    "<html><body>" + _NAV + _SIDE + '<section class="main-content"><h1 data-y>{h}</h1><div class="notice">{s} {p}</div><p data-y>{p}</p><table><tr><td data-y>{s}</td>'
    "<td data-y>{s}</td></tr></table><p data-y>{p}</p></section>" + _FORM + '<div class="banner promo"><p>{p}</p></div>' + _FOOT + "</body></html>",

    '<html><body><div class="breadcrumbs">{l} &raquo; {l}</div><article class="story"><h1 data-y>{h}</h1><p data-y>{p}</p>' + '<aside class="related"><p>{p}</p>{l}</aside>'
    "<p data-y>{p}</p><p data-y>{s}.</p></article>" + '<ol class="commentlist"><li>{p}</li><li>{s}</li></ol><div id="respond"><p>Leave a reply {s}</p></div>'
    + _COOKIE + "</body></html>",

    "<html><body><header>" + _NAV + "</header><main><h1 data-y>{h}</h1><div><p data-y>{p}</p><p data-y>{p}</p></div><div><p data-y>{p}</p></div></main>"
    '<div role="alert">{s} {p}</div><div class="popup">' + _FORM + "</div>" + _FOOT + "</body></html>",

    "<html><body>" + _NAV + '<article class="entry"><nav class="toc"><a href="#a">{s}</a><a href="#b">{s}</a></nav><h1 data-y>{h}</h1><p data-y>{p}</p>'
    + '<form class="login"><p>{s}</p><label>{s}</label><p>Log in to read more</p></form>' + "<p data-y>{p}</p>" + '<form action="/poll"><p>{p}</p><button>{s}</button></form>'
    '<p data-y>{p}</p><div class="sponsored"><p>{p}</p></div><p data-y>{p}</p><footer><p>{s}</p><p>{p}</p></footer></article>' + _COMMENTS + _FOOT + "</body></html>",

    "<html><body data-y>{p} {p}</body></html>",
)
