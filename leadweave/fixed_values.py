"""Word lists and patterns the results depend on. Plain data, no logic.

Sets are listed in alphabetical order, lists whose order counts in that order.
"""

# Legal forms dropped from company names.
LEGAL_FORMS = ("sarl sas sa eurl sci snc ltd llc inc gmbh bv nv spa oy").split()

# Contact-like paths, in the order they are tried.
CONTACT_PATHS = (
    "/contact /contact-us /contactez-nous /nous-contacter /about /about-us /a-propos "
    "/qui-sommes-nous /equipe /team /our-team /mentions-legales /legal /legal-notice "
    "/impressum /imprint /coordonnees /infos"
).split()

# Phrases that mark a sentence as boilerplate.
BOILERPLATE = [
    "cookie", "accept", "privacy policy", "terms of service", "all rights reserved",
    "nous utilisons des cookies", "accepter", "refuser", "mentions légales", "cliquez ici",
]

# Parts of a company name that mark a ranking or directory page.
JUNK_NAME_PARTS = [
    "top ", "meilleures", "meilleur", "comparatif", "classement",
    "les agences", " annuaire", "directory", "best ", "ranking",
]

# Sites that list companies instead of being one.
JUNK_SITES = (
    "01net.com 118000.fr 118712.fr agence-web.pro agence.fr agences-france.fr "
    "annuaire-agence.fr annuaire.org avis-verifies.com bfmtv.com clutch.co codeur.com "
    "facebook.com freelance.com google.com google.fr indeed.fr infogreffe.fr instagram.com "
    "journaldunet.com kompass.com lafabriquedunet.fr leboncoin.fr les-meilleures-agences.com "
    "linkedin.com malt.fr manageo.fr mappy.com pagesbleues.fr pagesjaunes.fr pappers.fr "
    "societe.com sortlist.be sortlist.com sortlist.fr topagences.fr tripadvisor.com "
    "tripadvisor.fr trustpilot.com trustpilot.fr twitter.com upwork.com verif.com "
    "web-agences.com welcometothejungle.com wikipedia.org x.com yelp.com yelp.fr youtube.com"
).split()

# Sites skipped among search results.
SEARCH_SKIP_SITES = (
    "118000.fr 118712.fr annuaire.org facebook.com google.com google.fr indeed.fr "
    "infogreffe.fr instagram.com kompass.com leboncoin.fr linkedin.com manageo.fr "
    "pagesbleues.fr pagesjaunes.fr pappers.fr societe.com tripadvisor.fr twitter.com "
    "verif.com welcometothejungle.com wikipedia.org x.com youtube.com"
).split()

# URL parts that rule a hit out when looking for a company's own site.
LOOKUP_SKIP_PARTS = (
    "annuaire clutch.co facebook.com fr.mappy.com google. indeed.fr infogreffe instagram.com "
    "leboncoin linkedin.com malt.fr mappy.com pagesjaunes pappers societe.com sortlist "
    "tripadvisor twitter.com verif.com wikipedia.org yelp. youtube.com"
).split()

# Endings cut from result titles, in order.
TITLE_SUFFIXES = [
    " - site officiel", " – site officiel", " | accueil", " - accueil", " | bienvenue",
]

# Beginnings of an answer that keep a lead.
ACCEPTED_ANSWERS = ["oui"]

# Placeholder and platform e-mail domains.
PLACEHOLDER_EMAIL_DOMAINS = (
    "bar.com company.com company.fr demo.com domain.com email.com example.com example.net "
    "example.org foo.com ipsum.com lorem.com my-company.com mycompany.com mydomain.com "
    "sample.com schema.org sentry.io squarespace.com test.com test.org testing.com w3.org "
    "website.com wixpress.com wordpress.com wordpress.org your-company.com your-domain.com "
    "your-site.com yourcompany.com yourdomain.com yoursite.com yourwebsite.com"
).split()

# Placeholder local parts.
PLACEHOLDER_LOCALS = (
    "demo email example exemple firstname.lastname name nom prenom.nom sample user username "
    "utilisateur votre-email votre.adresse votre.email votre.nom votreemail your-email "
    "your-name your.email your.name youremail"
).split()

# Parts of a local part that mark a placeholder.
PLACEHOLDER_LOCAL_PARTS = (
    "my-company my-domain mycompany mydomain placeholder your-company your-domain your-mail "
    "your-name your-site yourcompany yourdomain yourmail yourname yoursite"
).split()

# Domains without an ending.
BARE_EMAIL_DOMAINS = "company yourcompany mycompany domain example".split()

# Consumer e-mail providers.
FREE_EMAIL_DOMAINS = (
    "aol.com bbox.fr free.fr gmail.com gmx.com gmx.fr gmx.net googlemail.com hotmail.com "
    "hotmail.fr icloud.com laposte.net live.com live.fr mac.com mail.com me.com msn.com "
    "neuf.fr orange.fr outlook.com outlook.fr pm.me proton.me protonmail.com sfr.fr "
    "wanadoo.fr yahoo.com yahoo.fr yandex.com yandex.ru zoho.com"
).split()

# Image endings that look like e-mail endings.
IMAGE_ENDINGS = ".png .jpg .jpeg .gif .svg .webp .ico".split()

# Keyword -> column of the required-field filter.
REQUIRED_FIELDS = {
    "email": "email",
    "contact": "contact_page",
    "website": "website",
    "address": "address",
    "description": "description",
}

# Score weights.
FIELD_POINTS = {"website": 2, "address": 2, "contact_page": 1, "description": 1}
BUSINESS_EMAIL_POINTS = 3
FREE_EMAIL_POINTS = -2
MULTI_SOURCE_POINTS = 2

# Source names, in registry order.
SOURCE_NAMES = ["maps", "pj", "google"]

# Request addresses.
MAPS_URL = "https://www.google.com/maps/search/"
SEARCH_URL = "https://www.google.fr/search?q={term}&hl=fr&num=20"
LOOKUP_URL = "https://www.google.fr/search?q={term}&num=5&hl=fr"
DIRECTORY_URL = (
    "https://www.pagesjaunes.fr/annuaire/chercherlespros"
    "?quoiqui={what}&ou={where}&univers=pagesjaunes&idOu=&page={page}"
)

# Lengths.
DESCRIPTION_LENGTH = 300
MIN_META_LENGTH = 20
MIN_BLOCK_LENGTH = 50
SUMMARY_LENGTH = 100
MAX_CONTACT_PAGES = 4

# An e-mail address, as a pattern without groups.
ADDRESS = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"

# The characters stripped and matched as white space.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as the inside of a regular-expression class.
SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)
