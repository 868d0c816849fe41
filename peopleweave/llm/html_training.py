"""The small labelled table that the block classifier of html_blocks is trained on.

A page is a list of (label, opening tags, number of words, words inside links, closing tags); label 1 is main text. Pages are made up; they
show the usual places of menus, headers, footers, sidebars, notices, adverts, forms and comments around an article,
with and without elements that name it.
"""
# Hand-labelled pages.
PAGES = [
    [(0, "<body><nav><ul><li>", 1, 1, "</li>"), (0, "<li>", 2, 2, "</li></ul></nav>"), (0, '<div class="ad">', 9, 0, "</div>"), (1, "<article><h1>", 8, 0, "</h1>"), (1, "<p>", 60, 0, "</p>"),
     (1, "<p>", 7, 0, "</p>"), (1, "<p>", 130, 4, "</p></article>"), (0, "<footer>", 14, 1, "</footer>")],
    [(0, "<body><header><div>", 4, 1, "</div></header>"), (0, "<nav>", 6, 6, "</nav>"), (1, "<main><h1>", 6, 0, "</h1>"), (1, "<p>", 1, 0, "</p>"), (1, "<p>", 90, 10, "</p>"), (1, "<h2>", 3, 0, "</h2>"),
     (1, "<ul><li>", 5, 0, "</li>"), (1, "<li>", 12, 0, "</li></ul>"), (0, '<div class="share">', 3, 3, "</div></main>"), (0, "<aside><h3>", 2, 0, "</h3>"), (0, "<p>", 40, 0, "</p></aside>"), (0, "<footer><p>", 25, 2, "</p></footer>")],
    [(0, '<body><div id="cookie-notice"><p>', 35, 2, "</p></div>"), (0, '<div class="header">', 5, 0, "</div>"), (0, '<ul class="menu"><li>', 1, 1, "</li></ul>"), (1, '<div id="content"><h1>', 9, 0, "</h1>"), (1, "<p>", 75, 3, "</p>"),
     (1, "<p>", 22, 0, "</p>"), (1, "<blockquote>", 30, 0, "</blockquote></div>"), (0, '<div class="sidebar"><p>', 28, 3, "</p></div>"), (0, '<div id="footer">', 12, 4, "</div>")],
    [(0, "<body><div><ul><li>", 2, 2, "</li>"), (0, "<li>", 1, 1, "</li></ul></div>"), (1, "<div><h1>", 7, 0, "</h1>"), (1, "<p>", 110, 2, "</p>"), (1, "<p>", 45, 0, "</p></div>"), (0, "<div>", 5, 4, "</div>"), (0, "<div>", 3, 0, "</div>")],
    [(0, "<body><header>", 3, 1, "</header>"), (1, "<article><header><h1>", 10, 0, "</h1></header>"), (1, "<p>", 55, 0, "</p>"), (0, '<div class="advert"><p>', 16, 0, "</p></div>"), (1, "<p>", 4, 0, "</p>"), (1, "<p>", 14, 12, "</p>"),
     (0, "<form><label>", 4, 0, "</label></form>"), (1, "<p>", 80, 6, "</p>"), (0, "<footer>", 11, 3, "</footer></article>"), (0, '<section id="comments"><h2>', 2, 0, "</h2>"), (0, "<p>", 38, 0, "</p>"), (0, "<p>", 65, 0, "</p></section>"), (0, "<footer>", 9, 0, "</footer>")],
    [(0, '<body><p class="notice">', 20, 1, "</p>"), (0, "<nav>", 9, 8, "</nav>"), (1, "<article><p>", 33, 0, "</p>"), (1, "<p>", 2, 0, "</p>"), (0, '<aside class="related"><p>', 18, 16, "</p></aside>"), (1, "<p>", 150, 0, "</p></article>"),
     (0, "<div><p>", 42, 0, "</p></div>"), (0, "<div>", 12, 0, "</div>")],
    [(0, "<body><div>", 6, 6, "</div>"), (0, "<div>", 2, 0, "</div>"), (1, "<h1>", 6, 0, "</h1>"), (1, "<div>", 48, 0, "</div>"), (1, "<div>", 95, 4, "</div>"), (0, '<div class="newsletter"><form>', 10, 0, "</form></div>"),
     (0, '<div class="comment-list"><div>', 52, 1, "</div></div>"), (0, "<div>", 8, 8, "</div>"), (0, "<div>", 4, 0, "</div>")],
    [(0, '<body><div role="navigation">', 5, 5, "</div>"), (0, '<div class="banner">', 13, 0, "</div>"), (1, '<main><div><p>', 19, 0, "</p>"), (1, "<p>", 64, 22, "</p>"), (1, "<pre>", 26, 0, "</pre></div>"),
     (0, '<div class="popup"><p>', 30, 0, "</p></div>"), (1, "<p>", 9, 0, "</p></main>"), (0, '<div class="disclaimer">', 40, 0, "</div>")],
    [(1, "<body><p>", 70, 0, "</p>"), (1, "<p>", 40, 2, "</p>"), (1, "<p>", 21, 0, "</p>")],
    [(1, "<article><h1>", 3, 0, "</h1>"), (1, "<p>", 1, 0, "</p>"), (1, "<p>", 3, 0, "</p></article>"), (0, "<footer>", 5, 0, "</footer>")],
    [(1, "<article><p>", 30, 28, "</p>"), (1, "<table><tr><td>", 2, 0, "</td>"), (1, "<td>", 1, 0, "</td></tr></table>"), (1, "<p>", 5, 5, "</p>"), (1, "<ul><li>", 6, 2, "</li></ul></article>"), (0, "<aside>", 12, 0, "</aside>"), (0, "<p>", 15, 0, "</p>")],
    [(0, '<div class="topbar">', 4, 2, "</div>"), (1, '<div class="post-body"><p>', 24, 0, "</p>"), (1, "<h2>", 4, 0, "</h2>"), (1, "<p>", 52, 1, "</p></div>"), (0, '<div class="tags">', 5, 5, "</div>"), (0, '<div class="widget"><p>', 33, 0, "</p></div>")],
    [(0, "<body><div>", 45, 0, "</div>"), (1, "<article><p>", 25, 0, "</p>"), (1, "<p>", 84, 2, "</p></article>"), (0, "<div>", 60, 0, "</div>"), (0, "<p>", 33, 0, "</p>")],
    [(0, "<body><p>", 24, 0, "</p>"), (0, "<p>", 70, 5, "</p>"), (1, "<main><h1>", 5, 0, "</h1>"), (1, "<div>", 40, 0, "</div></main>"), (0, "<div>", 90, 0, "</div>")],
    [(0, "<body><nav><ul><li>", 1, 1, "</li></ul></nav>"), (1, "<article><h1>", 2, 0, "</h1>"), (1, "<p>", 1, 0, "</p>"), (1, "<p>", 3, 3, "</p>"), (1, "<p>", 2, 0, "</p></article>"), (0, "<p>", 10, 0, "</p>")],
    [(0, "<body><nav>", 5, 5, "</nav>"), (1, "<main><h1>", 1, 0, "</h1>"), (1, "<p>", 6, 6, "</p>"), (1, "<ul><li>", 1, 1, "</li>"), (1, "<li>", 2, 2, "</li></ul></main>"), (0, "<div>", 3, 3, "</div>"), (0, "<div>", 2, 0, "</div>")],
    [(0, "<body><div>", 3, 3, "</div>"), (1, "<article><h2>", 4, 0, "</h2>"), (1, "<p>", 2, 2, "</p>"), (1, "<pre>", 12, 0, "</pre>"), (0, '<div class="tags">', 3, 3, "</div></article>"), (0, "<div>", 7, 0, "</div>")],
    [(0, '<body><form id="aspnetForm"><div class="menu">', 5, 5, "</div>"), (1, "<article><h1>", 6, 0, "</h1>"), (1, "<p>", 48, 1, "</p>"), (1, "<p>", 66, 0, "</p></article>"), (0, '<section class="comments"><article><p>', 31, 0, "</p></article></section>"),
     (0, '<div class="footer">', 9, 3, "</div></form>")],
    [(0, '<body><div class="layout has-sidebar"><header>', 4, 1, "</header>"), (1, '<article><header class="entry-header"><h1>', 7, 0, "</h1></header>"), (1, "<p>", 58, 2, "</p>"), (1, "<p>", 34, 0, "</p></article>"),
     (0, '<div class="sidebar"><p>', 26, 2, "</p></div></div>")],
    [(0, '<body><div id="reader"><div class="share">', 4, 4, "</div>"), (1, "<main><p>", 44, 0, "</p>"), (1, "<p>", 71, 3, "</p></main></div>"), (0, "<footer>", 8, 2, "</footer>")],
    [(0, '<body><form action="page.aspx"><ul class="nav"><li>', 3, 3, "</li></ul>"), (1, '<div id="content"><h1>', 5, 0, "</h1>"), (1, "<p>", 85, 2, "</p>"), (1, "<p>", 37, 0, "</p></div>"), (0, '<div class="search">', 3, 0, "</div></form>")],
]
