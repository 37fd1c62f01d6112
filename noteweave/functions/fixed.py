"""Fixed values.

Everything here must equal the values of the behaviour being reproduced: file
extensions, selectors, class names, thresholds, message texts, document headers.
"""

# --- file extensions by class ------------------------------------------------
FILE_CLASSES = {
    "image": ["jpg", "jpeg", "png", "gif", "webp", "bmp", "svg", "ico", "tiff", "tif", "psd", "ai", "eps"],
    "video": ["mp4", "avi", "mov", "wmv", "flv", "webm", "mkv", "m4v", "3gp", "ogv", "mpg", "mpeg"],
    "audio": ["mp3", "wav", "ogg", "m4a", "aac", "flac", "wma", "opus", "amr"],
    "pdf": ["pdf"],
    "document": ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "rtf"],
    "archive": ["zip", "rar", "7z", "tar", "gz", "bz2", "xz", "dmg", "iso"],
    "binary": [
        "exe", "msi", "app", "deb", "rpm", "apk", "ipa",
        "db", "sqlite", "bin", "dat", "pak",
        "ttf", "otf", "woff", "woff2", "eot",
        "swf", "fla", "sketch",
    ],
}

# --- stub bodies by file class; {url} is escaped, {file} and {ext} are not -----
FILE_STUBS = {
    "image": '<div>\n<img src="{url}" alt="Image"/>\n<p>Image: {file}</p>\n</div>',
    "video": '<div>\n<p>Video file: <a href="{url}">{file}</a></p>\n'
    "<p><em>Video preview not available in Evernote</em></p>\n</div>",
    "audio": '<div>\n<p>Audio file: <a href="{url}">{file}</a></p>\n'
    "<p><em>Audio preview not available in Evernote</em></p>\n</div>",
    "pdf": '<div>\n<p>PDF document: <a href="{url}">{file}</a></p>\n</div>',
    "document": '<div>\n<p>Document: <a href="{url}">{file}</a></p>\n</div>',
    "archive": '<div>\n<p>Archive file: <a href="{url}">{file}</a></p>\n</div>',
    "binary": '<div>\n<p>Binary file ({ext}): <a href="{url}">{file}</a></p>\n</div>',
}
CONTENT_TYPE_STUB = (
    '<div>\n<p>File: <a href="{url}">{file}</a></p>\n<p><small>Content-Type: {mime}</small></p>\n</div>'
)
TEXT_CONTENT_TYPES = ["text/html", "text/plain"]

# --- character sets looked for in the first bytes of a body --------------------
CHARSET_WINDOW = 1024
CHARSET_MARKS = {
    "euc-jp": ["charset=EUC-JP", "charset=euc-jp"],
    "shift_jis": ["charset=Shift_JIS", "charset=shift_jis"],
}
DEFAULT_CHARSET = "utf8"

# --- page clean-up and content selectors ---------------------------------------
DROP_TAGS = ["script", "style", "noscript", "nav", "footer", "header", "aside"]
DROP_CLASSES = [
    "sidebar", "ads", "advertisement", "social-share", "comments", "navigation", "breadcrumb",
    "menu", "nav", "navbar", "header", "footer", "related", "recommend",
]
INNER_DROP_TAGS = ["nav"]
INNER_DROP_CLASSES = ["nav", "menu", "sidebar", "social", "share", "twitter", "facebook"]

# Candidate elements in order of preference (rank 1 first).
CONTENT_SELECTORS = [
    "article .content",
    "article .post-content",
    "article .entry-content",
    "article .text",
    ".article-content",
    ".post-content",
    ".entry-content",
    ".content",
    "article",
    "main",
    '[role="main"]',
    "#content",
    ".post-body",
    ".article-body",
    ".article",
    ".story",
    ".entry",
    ".post",
    "#main",
    "#article",
    "#story",
    "body",
]
LONGEST_BLOCK_TAGS = ["div", "section", "article", "p"]

MIN_CANDIDATE_CHARS = 100  # a candidate's text must be longer
MIN_CONTENT_CHARS = 50  # shorter content counts as not extracted
MIN_LINE_CHARS = 20  # a kept line must be longer
PARAGRAPH_CHARS = 150  # a paragraph longer than this is closed
SENTENCE_END = "。"
PARAGRAPH_MARKS = ["：", "■"]

# --- message texts ---------------------------------------------------------------
TEXT_NOT_EXTRACTED = "<p>Content could not be extracted from {url}{suffix}</p>"
TEXT_NO_LINES = "<p>Content extracted from {url}{suffix}</p>"
TEXT_FETCH_FAILED = "<p>Failed to scrape content from {url}{suffix}: {error}</p>"
RENDERED_SUFFIX = " (browser)"
FAILURE_MARKS = ["Failed to scrape", "Content could not be extracted"]
METHOD_LABELS = {
    "lightweight": "Scraped via HTTP",
    "browser": "Scraped via Browser",
    "failed": "Scraping Failed",
}
LABEL_LINE = "\n<p><small>[{label}]</small></p>"

# --- note and export documents ------------------------------------------------------
ARTICLE_BODY = (
    "\n<h1>{title}</h1>\n<div>\n"
    '<a href="{url}">Original Article</a>\n</div>\n<hr/>\n<div>\n'
    "{content}\n</div>\n<hr/>\n<div>\n<small>\n"
    "URL: {url}<br/>\nStatus: {status}<br/>\nScraped: {day}\n</small>\n</div>"
)
LINK_BODY = (
    '\n<div>\n<a href="{url}">{title}</a>\n</div>\n<div>\n<br/>\n</div>\n'
    "<div>\nURL: {url}\n</div>\n<div>\nStatus: {status}\n</div>"
)
NOTE_DOCUMENT = (
    '<?xml version="1.0" encoding="UTF-8" standalone="no"?>\n'
    '<!DOCTYPE en-note SYSTEM "http://xml.evernote.com/pub/enml2.dtd">\n'
    "<en-note>\n{body}\n</en-note>"
)
NOTE_SOURCE = "web.clip"
EXPORT_APPLICATION = "Evernote"
EXPORT_VERSION = "10.0"
EXPORT_PROLOG = (
    '<?xml version="1.0" encoding="UTF-8"?>\n'
    '<!DOCTYPE en-export SYSTEM "http://xml.evernote.com/pub/evernote-export3.dtd">\n'
)
EXPORT_OPEN = '<en-export export-date="{date}" application="{application}" version="{version}">'
EXPORT_CLOSE = "</en-export>"
PART_NAME = "%s_part%03d.enex"

# --- defaults of the job options -------------------------------------------------------
DEFAULT_BATCH_SIZE = 10
DEFAULT_CHECKPOINT_INTERVAL = 100
DEFAULT_NOTES_PER_PART = 1000
FAILURES_SHOWN = 10

# --- elements whose end tag may be left out (fixed values of HTML) -----------------------
# Each group: its elements, the element around them, and other tags in front of which they end.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "pre", "search", "section",
    "table", "ul",
]
IMPLIED_ENDS = [
    (["li"], ["ul", "ol"], []),
    (["dt", "dd"], ["dl"], []),
    (["tr"], ["table"], ["tbody", "thead", "tfoot"]),
    (["td", "th"], ["table"], ["tr", "tbody", "thead", "tfoot"]),
    (["option"], ["select"], ["optgroup"]),
    (["p"], [], BLOCK_TAGS),
]
