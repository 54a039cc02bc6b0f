from postlens.sources.posts import (  # noqa: F401
    POSTS_SCHEMA, posts_from_tables, scan_posts, nan_to_null, ingest_posts,
)
from postlens.sources.comments import comments_from_tables  # noqa: F401
from postlens.sources.corpus import (  # noqa: F401
    scan_corpus, keyword_trends, labelled_corpus, write_corpus_from_conversations,
)
