"""Records of services, as they are landed in JSON, made into candidates. Nothing is fetched.

Each function takes a frame of one service's records, as `spark.read.json` gives them with the schema named here, and
returns candidates: id, title, url, source, source_type, published_at, summary, author, tags, hotness and metrics. A
record that is no candidate gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, contains_any, known, once, unescape
from ..operators.predicates import first_reason

REPOSITORY = "id long, full_name string, description string, html_url string, created_at string, pushed_at string, stargazers_count long, forks_count long, topics array<string>, owner struct<login string>"
RELEASE = "tag_name string, html_url string, body string, published_at string, draft boolean, prerelease boolean"
MODEL = "id string, modelId string, pipeline_tag string, tags array<string>, likes long, downloads long, description string, author string, lastModified string, cardData struct<model_name string, description string>"
PAPER = "id string, title string, summary string, authors array<struct<name string>>, published timestamp, primary_category string"
POST = "tweet_id string, text string, url string, source_name string, source_handle string, author string, source_tier string, created_at timestamp, is_repost boolean"

#: Names of repositories that only collect or teach, and the least that one must have.
LISTS = (
    "awesome-", "awesome_", "-list", "_list", "tutorial", "course", "learn-", "learning-", "interview", "cheatsheet", "cheat-sheet", "notes", "roadmap", "guide-", "handbook",
    "best-practice", "coding-interview", "mirror", "backup", "archive", "resources", "collection",
)
LEAST_STARS, LEAST_DESCRIPTION, LEAST_NOTES = 5, 24, 40
#: Tasks of models that count, other names of tasks, and what they are called.
TASKS = (
    "text-generation", "text2text-generation", "image-generation", "video-generation", "text-to-image", "image-to-text", "text-to-video", "image-to-video", "automatic-speech-recognition",
    "text-to-speech", "multimodal", "visual-question-answering", "document-question-answering", "image-segmentation", "image-classification", "object-detection", "reinforcement-learning", "robotics",
)
TASK_NAMES = {"image-text-to-text": "multimodal", "visual-question-answering": "multimodal"}
CATEGORIES = {
    "text-generation": "文本生成", "text2text-generation": "文本生成", "image-generation": "图像生成", "video-generation": "视频生成", "text-to-image": "文本到图像", "image-to-text": "图像理解",
    "text-to-video": "文本到视频", "image-to-video": "图像到视频", "automatic-speech-recognition": "语音识别", "text-to-speech": "语音合成", "multimodal": "多模态", "reinforcement-learning": "强化学习", "robotics": "机器人",
}
#: Words of papers at the core of the field.
PAPER_WORDS = (
    "large language model", "llm", "gpt", "transformer", "diffusion model", "diffusion", "stable diffusion", "multimodal", "vision-language", "vision language", "text-to-image", "text-to-video",
    "image generation", "video generation", "speech recognition", "tts", "reinforcement learning", "deep reinforcement", "rlhf", "alignment", "safety", "neural network", "deep learning",
    "representation learning", "agent", "agentic", "multi-agent", "rag", "retrieval-augmented", "retrieval augmented", "prompt", "in-context learning", "few-shot", "chain-of-thought",
    "chain of thought", "reasoning", "fine-tuning", "fine tuning", "instruction tuning", "benchmark", "evaluation", "sota", "mixture of experts", "moe", "contrastive", "self-supervised",
    "generative adversarial", "gan", "variational autoencoder", "vae", "attention mechanism", "self-attention", "embedding", "tokenization", "quantization", "pruning", "distillation", "federated learning",
)
POST_TIERS = ("primary", "research", "media")
COLUMNS = ("id", "title", "url", "source", "source_type", "published_at", "summary", "author", "tags", "hotness")


def service_time(value: Column) -> Column:
    """A time as the services write it, with or without a fraction of a second; null for anything else."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
    return F.when(known(value).rlike(shape), F.try_to_timestamp(value))


def cut(value: Column, most: int) -> Column:
    """White space collapsed, at most so many characters, none of them white space at the end."""
    return F.trim(F.left(collapse(value), F.lit(most)))


def low_value(name: Column, description: Column, stars: Column) -> Column:
    n, d = F.lower(known(name)), F.lower(known(description))
    return (F.coalesce(stars, F.lit(0)) < LEAST_STARS) | contains_any(n, LISTS) | contains_any(d, LISTS)


def readme_excerpt(content: Column, most: int = 600) -> Column:
    """The prose of a README in Markdown: no comments, pictures, marks of headings and lists, and links as their text."""
    lines = F.transform(F.split(known(content), r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("<!--") & ~x.startswith("![]"))
    def without(shape: str, by: str):
        return lambda x: F.regexp_replace(x, shape, by)

    for shape, by in ((r"^#{1,6}\s*", ""), (r"^[-*>]+\s*", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1")):
        lines = F.transform(lines, without(shape, by))
    return cut(F.array_join(F.filter(lines, lambda x: x != ""), " "), most)


def _heat(stars: Column, forks: Column, bonus: Column) -> Column:
    return F.bround(F.log1p(stars) * 3 + F.log1p(forks) * 1.5 + bonus, 1)


def repositories(records: DataFrame, cutoff: Column) -> DataFrame:
    """Repositories as code activity: pushed to since the cutoff, or new."""
    stars, forks = F.coalesce("stargazers_count", F.lit(0)), F.coalesce("forks_count", F.lit(0))
    description = F.trim(known(F.col("description")))
    timed = records.where((known(F.col("full_name")) != "") & ~low_value(F.col("full_name"), F.col("description"), F.col("stargazers_count"))).withColumn("_made", service_time(F.col("created_at"))).withColumn("_pushed", service_time(F.col("pushed_at")))
    pushed = F.coalesce((F.col("_pushed") >= cutoff) & (F.col("_made").isNull() | (F.col("_pushed") > F.col("_made"))), F.lit(False))
    summary = F.concat(F.lit("GitHub "), F.when(pushed, "近期推送活跃").otherwise("近期开源"), F.lit("项目，当前 "), stars.cast("string"), F.lit(" stars、"), forks.cast("string"), F.lit(" forks。"), description)
    return timed.select(
        F.concat(F.lit("github-"), F.col("id").cast("string")).alias("id"), F.left(F.when(description != "", F.concat("full_name", F.lit(": "), description)).otherwise(F.col("full_name")), F.lit(200)).alias("title"),
        known(F.col("html_url")).alias("url"), F.lit("GitHub").alias("source"), F.lit("github").alias("source_type"), F.when(pushed, F.col("_pushed")).otherwise(F.col("_made")).alias("published_at"),
        F.left(F.trim(summary), F.lit(300)).alias("summary"), known(F.col("owner.login")).alias("author"), F.coalesce("topics", F.array().cast("array<string>")).alias("tags"),
        _heat(stars, forks, F.when(pushed, 8.0).otherwise(5.0)).alias("hotness"), F.when(pushed, "recent_push").otherwise("new_repository").alias("activity"), stars.alias("github_stars"),
    )


def releases(records: DataFrame, cutoff: Column) -> DataFrame:
    """Stable releases that explain themselves. records: the columns of REPOSITORY, `release` as a struct of RELEASE, and `readme`."""
    r = F.col("release")
    described = F.when(readme_excerpt(F.col("readme")) != "", readme_excerpt(F.col("readme"))).otherwise(cut(F.col("description"), 600))
    clean = records.where(~low_value(F.col("full_name"), F.col("description"), F.col("stargazers_count"))).select(
        "*", F.trim(known(F.col("full_name"))).alias("_name"), cut(r["tag_name"], 80).alias("_tag"), cut(r["html_url"], 500).alias("_url"), cut(r["body"], 1400).alias("_notes"),
        described.alias("_about"), service_time(r["published_at"]).alias("_at"),
    )
    off = [
        ("no_name", F.col("_name") == ""), ("draft", F.coalesce(r["draft"], F.lit(False)) | F.coalesce(r["prerelease"], F.lit(False))), ("no_tag", (F.col("_tag") == "") | (F.col("_url") == "")),
        ("old", F.col("_at").isNull() | (F.col("_at") < cutoff)), ("unexplained", (F.length("_about") < LEAST_DESCRIPTION) | (F.length("_notes") < LEAST_NOTES)),
    ]
    stars, forks = F.coalesce("stargazers_count", F.lit(0)), F.coalesce("forks_count", F.lit(0))
    summary = F.concat(F.lit("GitHub Release "), "_tag", F.lit(". Project: "), "_about", F.lit(". Release notes: "), "_notes")
    return clean.where(first_reason(off) == "").select(
        F.concat(F.lit("github-release-"), F.col("id").cast("string"), F.lit("-"), "_tag").alias("id"), F.left(F.concat("_name", F.lit(" releases "), "_tag"), F.lit(200)).alias("title"), F.col("_url").alias("url"),
        F.lit("GitHub").alias("source"), F.lit("github").alias("source_type"), F.col("_at").alias("published_at"), F.left(summary, F.lit(2000)).alias("summary"), known(F.col("owner.login")).alias("author"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("tags"), _heat(stars, forks, F.lit(12.0)).alias("hotness"), F.lit("github_release").alias("activity"), stars.alias("github_stars"),
        F.col("_about").alias("project_description"), F.col("_notes").alias("release_notes"),
    )


def task_of(task: Column, tags: Column) -> Column:
    """The first of a model's task and tags that is a task which counts, or an empty string."""
    other = F.create_map(*[F.lit(v) for pair in TASK_NAMES.items() for v in pair])
    named = F.transform(F.concat(F.array(known(task)), F.coalesce(tags, F.array().cast("array<string>"))), lambda t: F.coalesce(F.element_at(other, t), t))
    return F.coalesce(F.get(F.filter(named, lambda t: t.isin(*TASKS)), F.lit(0)), F.lit(""))


def models(records: DataFrame) -> DataFrame:
    """Models of a task that counts, with ten likes, or three and many downloads."""
    likes, loads = F.coalesce("likes", F.lit(0)), F.coalesce("downloads", F.lit(0))
    card = F.col("cardData")
    description = F.left(F.coalesce(*[F.when(known(c) != "", c) for c in (F.col("description"), card["description"])], F.lit("")), F.lit(300))
    title = F.when(known(card["model_name"]) != "", F.concat(card["model_name"], F.lit(" ("), "id", F.lit(")"))).when(known(F.col("modelId")) != "", F.col("modelId")).otherwise(F.col("id"))
    names = F.create_map(*[F.lit(v) for pair in CATEGORIES.items() for v in pair])
    kept = records.withColumn("_task", task_of(F.col("pipeline_tag"), F.col("tags"))).where((known(F.col("id")) != "") & (F.col("_task") != "") & ((likes >= 10) | ((likes >= 3) & (loads >= 5000))))
    category = F.coalesce(F.element_at(names, F.col("_task")), F.col("_task"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    author = F.when(F.col("id").contains("/"), F.when(known(F.col("author")) != "", F.col("author")).otherwise(F.substring_index("id", "/", 1))).otherwise("")
    summary = F.concat(F.lit("Hugging Face 模型，类型："), category, F.lit("；点赞 "), likes.cast("string"), F.lit("，累计下载 "), loads.cast("string"), F.lit("。"), description)
    return kept.select(
        F.concat(F.lit("hf-"), "id").alias("id"), F.left(title, F.lit(200)).alias("title"), F.concat(F.lit("https://huggingface.co/"), "id").alias("url"), F.lit("Hugging Face").alias("source"),
        F.lit("huggingface").alias("source_type"), service_time(F.col("lastModified")).alias("published_at"), F.left(F.trim(summary), F.lit(300)).alias("summary"), author.alias("author"),
        F.when(F.array_contains(tags, category), tags).otherwise(F.array_append(tags, category)).alias("tags"), F.bround(F.log1p(likes) * 3 + F.log1p(loads) * 0.5, 1).alias("hotness"), (likes < 10).alias("by_downloads"),
    )


def core_paper(title_and_abstract: Column) -> Column:
    return contains_any(F.lower(known(title_and_abstract)), PAPER_WORDS)


def papers(records: DataFrame) -> DataFrame:
    strip = lambda c: F.regexp_replace(unescape(c), r"^\s+|\s+$", "")
    number = F.when(known(F.col("id")).contains("/abs/"), F.substring_index("id", "/abs/", -1)).otherwise("")
    first = F.concat(known(F.get("authors", F.lit(0))["name"]), F.when(F.size("authors") > 1, " et al.").otherwise(""))
    summary = F.left(F.left(strip(F.col("summary")), F.lit(500)), F.lit(300))
    tags = F.concat(F.when(known(F.col("primary_category")) != "", F.array("primary_category")).otherwise(F.array().cast("array<string>")), F.array(F.lit("paper"), F.lit("research")))
    return records.select(
        F.concat(F.lit("arxiv-"), number).alias("id"), F.left(F.concat(strip(F.col("title")), F.lit(" ["), F.coalesce(first, F.lit("")), F.lit("]")), F.lit(200)).alias("title"),
        F.when(number != "", F.concat(F.lit("https://arxiv.org/abs/"), number)).otherwise(known(F.col("id"))).alias("url"), F.lit("arXiv").alias("source"), F.lit("arxiv").alias("source_type"),
        F.col("published").alias("published_at"), summary.alias("summary"), F.coalesce(first, F.lit("")).alias("author"), tags.alias("tags"), F.lit(8.0).alias("hotness"),
        core_paper(F.concat_ws(" ", F.col("title"), F.col("summary"))).alias("core"),
    )


def posts(records: DataFrame) -> DataFrame:
    """Public posts of known accounts; a post without a number, a text, a known tier or its own address gives no row."""
    number = once(F.trim(known(F.col("tweet_id"))), lambda n: F.when(n.rlike("^[0-9]{1,32}$"), n).otherwise(""))
    handle = F.regexp_replace(collapse(F.col("source_handle")), "^@+", "")
    text = F.regexp_replace(known(F.col("text")), r"^\s+|\s+$", "")
    own = F.regexp_extract(known(F.col("url")), r"^https://(?:www\.)?x\.com/([^/]+)/status/([0-9]+)/?$", 1)
    own_number = F.regexp_extract(known(F.col("url")), r"^https://(?:www\.)?x\.com/([^/]+)/status/([0-9]+)/?$", 2)
    name = collapse(F.col("source_name"))
    fits = (number != "") & (text != "") & (name != "") & (handle != "") & (collapse(F.col("author")) != "") & F.col("source_tier").isin(*POST_TIERS) & F.col("created_at").isNotNull() & (F.lower(own) == F.lower(handle)) & (own_number == number)
    return records.where(fits & ~F.coalesce("is_repost", F.lit(False))).select(
        F.concat(F.lit("x-"), number).alias("id"), F.left(F.concat(name, F.lit(": "), F.left(collapse(text), F.lit(180))), F.lit(200)).alias("title"), F.col("url"), F.concat(name, F.lit(" (X)")).alias("source"),
        F.lit("x").alias("source_type"), F.col("created_at").alias("published_at"), F.left(text, F.lit(900)).alias("summary"), collapse(F.col("author")).alias("author"), F.array(F.lit("x")).alias("tags"), F.lit(0.0).alias("hotness"),
    )
