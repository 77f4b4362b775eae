"""Settings under which the given tables are read as websites."""

from __future__ import annotations

from pagesearch.config import LandingPage, SiteConfig
from pagesearch.functions.scores import boost_pages, boost_top_level_pages
from pagesearch.operators.validate import title_marker, url_suffix

ROOT = "https://docs.example.com/latest"

# The `documents` table as one documentation site: /<source>/<lang>/<doc_id>
CORPUS = SiteConfig(
    url=ROOT,
    literal_terms=("by-nc", "2.0", "4.0", "233.233"),
    synonym_groups={
        "with": ("avec", "dans la"),
        "negation": ("nicht", "pas"),
        "exact": ("para",),
    },
    landing_pages=(
        LandingPage("avec", "With", "/guides/with/", "All about with", hierarchy=("Guides",)),
        LandingPage("src1", "Source one", "src1", "Start here"),
        LandingPage("licence", "Licences", "/legal/", "Terms of use", "Legal", ("Legal",)),
    ),
    scorers=(boost_pages, boost_top_level_pages),
    score_hierarchy="resolved",
)

# The `pages` table: one site per host, all read with these settings
PAGES = SiteConfig(
    url="",
    content_selectors=("main", "article"),
    header_tags=("h1",),
    allow=("example",),
    deny=(r"\.pdf", r"/tag/", r"/the"),
    literal_terms=("2.0", "4.0"),
    validators=(title_marker("%%%"), url_suffix(".html")),
    scorers=(boost_pages, boost_top_level_pages),
)
