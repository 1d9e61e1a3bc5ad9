"""Pages in forms that none of the given tables hold, and texts that only look like them.

Measured before the patterns knew them: 33 of the 42 pages were found, and 3 of the 13 look-alikes. The gaps were then
closed, so these are no longer held out.
"""

import pytest

from cairn.llm.residue import page

PAGES = [
    ("error","<html><head><title>Oops! 404</title></head><body><h1>This page has vanished</h1><p>The link you followed may be broken.</p></body></html>"),
    ("error","Hmm. We're having trouble finding that site.\n\nWe can't connect to the server at www.example.org.\n"),
    ("error","Error 1020\n\nAccess denied\n\nThis website is using a security service to protect itself from online attacks.\n"),
    ("error","Whitelabel Error Page\n\nThis application has no explicit mapping for /error, so you are seeing this as a fallback.\n\nThere was an unexpected error (type=Not Found, status=404).\n"),
    ("error","nginx\n\n504 Gateway Time-out\n"),
    ("error","Service Temporarily Unavailable\n\nThe server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.\n"),
    ("error",'{"timestamp":"2024-01-01","status":500,"error":"Internal Server Error","path":"/api"}'),
    ("error","This site is down for maintenance.\n"),
    ("error","The requested URL /x was not found on this server.\n\nApache/2.4 Server at example.org Port 80\n"),
    ("error","Sorry, you have been blocked\n\nYou are unable to access example.org\n"),
    ("error","Seite nicht gefunden\n\nDie angeforderte Seite existiert nicht oder wurde verschoben.\n"),
    ("error","Página no encontrada\n\nLo sentimos, la página que busca no existe.\n"),
    ("error","Sivua ei löytynyt (404)\n\nPyytämääsi sivua ei ole olemassa.\n"),
    ("error","HTTP Status 403 – Forbidden\n\nType Status Report\n"),
    ("error","Your session has timed out. Please sign in again.\n"),
    ("error","You need to log in to see this page.\n"),
    ("error","This video is unavailable\n"),
    ("error","Too many requests. Slow down.\n"),
    ("error","Just a moment...\n\nexample.org needs to review the security of your connection before proceeding.\n"),
    ("error","502 - Web server received an invalid response while acting as a gateway or proxy server.\n"),
    ("script","We're sorry but app doesn't work properly without JavaScript enabled. Please enable it to continue.\n"),
    ("script","<html><body><div id=root></div><noscript>Diese Seite benötigt JavaScript.</noscript></body></html>"),
    ("script","This site requires scripting. Allow scripts and reload.\n"),
    ("script","Ihr Browser unterstützt kein JavaScript oder es ist deaktiviert.\n"),
    ("script","Veuillez activer JavaScript dans votre navigateur pour continuer.\n"),
    ("script","Bu sayfayı görüntülemek için JavaScript'i etkinleştirin.\n<noscript></noscript>"),
    ("script","JavaScript is turned off in your web browser. Turn it on to take full advantage of this site, then refresh the page.\n"),
    ("template","Hello {{first_name}},\n\nYour order {{order_id}} has shipped.\n"),
    ("template","# [Project Name]\n\n[One sentence description]\n\n## Installation\n\n[Installation steps]\n"),
    ("template","Subject: [SUBJECT]\n\nDear [RECIPIENT NAME],\n\n[BODY]\n\nSincerely,\n[YOUR NAME]\n"),
    ("template","Name: ____________\nDate: ____________\nSignature: ____________\n"),
    ("template","Title: <TITLE>\nAuthor: <AUTHOR>\nAbstract: <ABSTRACT>\n"),
    ("template","## Summary\n\n<!-- Describe your changes -->\n\n## Checklist\n\n- [ ] TODO\n"),
    ("template","Copyright (c) <YEAR> <COPYRIGHT HOLDER>\n"),
    ("template","Hi %FIRSTNAME%,\nwelcome to %COMPANY%.\n"),
    ("template","Sehr geehrte(r) [Name],\n\nvielen Dank für Ihre Bestellung [Bestellnummer].\n"),
    ("filler","Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor.\n"),
    ("filler","Dies ist ein Blindtext.\n\nDies ist ein Blindtext.\n"),
    ("filler","Your content goes here.\n"),
    ("filler","asdf asdf asdf asdf asdf asdf asdf\n"),
    ("filler","Test test test test test test test test\n"),
    ("filler","Coming soon\n\nThis page is under construction.\n"),
]
CONTENT = [
    "Fix 404 handling in the router\n\nThe router returned an empty body for unknown paths. It now renders the error page with the right status.\n",
    "How to enable JavaScript\n\nOpen the settings of your browser. Choose the privacy tab and scroll to the site permissions. There you can allow scripts for each site.\n",
    "# Error handling\n\nThe client retries when the server answers with 503 Service Unavailable. After three attempts it gives up and writes the response to the log.\n",
    "def not_found(request):\n    return Response('Page not found', status=404)\n",
    "Hello {{ name }},\n{% if order %}\nYour order {{ order.id }} has shipped.\n{% endif %}\n",
    "Reverts the change that disabled JavaScript bundling, since the preview broke on older browsers. The build is green again.\n",
    "Meeting notes: we agreed that the access denied page needs a contact link. Maria writes the text until Friday. The design stays as it is.\n",
    "The tests use lorem ipsum as sample input. Replace it when the fixtures are regenerated. See the guide for the steps.\n",
    "Update dependencies\n",
    "Bump js-yaml to 4.1\n",
    "Use NAME and COMPANY from the form instead of constants. The exporter reads them once at the start. Tests cover both.\n",
    "SELECT NAME, COMPANY FROM customers WHERE CITY = 'x';\n",
    "The session expired too early because the clock of the worker was off. The fix compares with the server's time and adds a test.\n",
]


@pytest.mark.parametrize("kind, text", PAGES)
def test_pages(kind, text):
    # An unfilled template may show by filler as well.
    assert page(text).kind in {kind, "filler" if kind == "template" else kind}


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    p = page(text)
    assert p is None or p.kind == ""
