"""Hosts by the longest rule that fits them, and addresses that look like profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import urls

#: Most bytes of rules or hosts that are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20

#: Hosts of networks.
NETWORKS = {
    "x": "x.com twitter.com mobile.twitter.com www.twitter.com", "facebook": "facebook.com www.facebook.com fb.com fb.me m.facebook.com", "instagram": "instagram.com www.instagram.com",
    "youtube": "youtube.com www.youtube.com m.youtube.com youtu.be", "linkedin": "linkedin.com www.linkedin.com", "tiktok": "tiktok.com www.tiktok.com vm.tiktok.com", "reddit": "reddit.com www.reddit.com old.reddit.com",
    "discord": "discord.com discord.gg discordapp.com www.discordapp.com", "twitch": "twitch.tv www.twitch.tv", "github": "github.com www.github.com", "gitlab": "gitlab.com", "bluesky": "bsky.app",
    "threads": "threads.net www.threads.net threads.com www.threads.com", "tumblr": "tumblr.com www.tumblr.com", "pinterest": "pinterest.com www.pinterest.com pin.it", "snapchat": "snapchat.com www.snapchat.com",
    "telegram": "t.me telegram.me telegram.org", "medium": "medium.com www.medium.com", "substack": "substack.com www.substack.com", "patreon": "patreon.com www.patreon.com", "vimeo": "vimeo.com www.vimeo.com",
    "cssbattle": "cssbattle.dev www.cssbattle.dev", "codepen": "codepen.io www.codepen.io", "soundcloud": "soundcloud.com www.soundcloud.com", "spotify": "open.spotify.com spotify.com", "bandcamp": "bandcamp.com",
    "flickr": "flickr.com www.flickr.com", "stackoverflow": "stackoverflow.com www.stackoverflow.com", "keybase": "keybase.io", "matrix": "matrix.to", "weibo": "weibo.com www.weibo.com m.weibo.cn",
    "bilibili": "bilibili.com www.bilibili.com space.bilibili.com", "xiaohongshu": "xiaohongshu.com www.xiaohongshu.com xhslink.com", "zhihu": "zhihu.com www.zhihu.com", "line": "line.me page.line.me",
    "kakao": "story.kakao.com open.kakao.com", "naver": "naver.com www.naver.com blog.naver.com", "pixiv": "pixiv.net www.pixiv.net", "vk": "vk.com www.vk.com vk.ru m.vk.com", "odnoklassniki": "ok.ru www.ok.ru",
    "mastodon": "mastodon.social mastodon.online mastodon.world mstdn.social mstdn.jp fosstodon.org hachyderm.io infosec.exchange tech.lgbt indieweb.social mas.to chaos.social octodon.social pawoo.net m.cmx.im xoxo.zone www.xoxo.zone",
    "librefm": "libre.fm www.libre.fm",
}
#: Suffixes below which each host is of a network.
SUFFIXES = {"substack.com": "substack", "medium.com": "medium", "bandcamp.com": "bandcamp", "tumblr.com": "tumblr", "github.io": "github", "gitlab.io": "gitlab"}


def rules_of(hosts: DataFrame, pattern: str, exact: str, network: str) -> DataFrame:
    """Rules (pattern, exact, network): an exact host, or a suffix of whole labels, written without its first dot."""
    return hosts.select(F.lower(F.regexp_replace(pattern, r"^\.|\.$", "")).alias("pattern"), F.col(exact).alias("exact"), F.col(network).alias("network"))


def networks(spark) -> DataFrame:
    """The rules of NETWORKS and SUFFIXES."""
    return spark.createDataFrame([(h, True, n) for n, hosts in NETWORKS.items() for h in hosts.split()] + [(s, False, n) for s, n in SUFFIXES.items()], "pattern string, exact boolean, network string")


def classified(rows: DataFrame, host: str, rules: DataFrame, other: str = "web") -> DataFrame:
    """rows with network: that of the rule for their host itself, else of the longest suffix below which it lies, else `other`. Each distinct
    host offers itself and its suffixes by whole labels to one equi-join with the rules; of rules with one pattern the least network holds.
    Rows get their host's network by a join that is broadcast while hosts are few."""
    own = F.regexp_replace(F.lower(F.trim(host)), r"\.$", "")
    labels = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"), (i == 1).alias("exact")))
    hosts = rows.select(own.alias("_h")).where("_h <> ''").distinct()
    once = rules.groupBy("pattern", "exact").agg(F.min("network").alias("network"))
    few = once.agg(F.coalesce(F.sum(F.octet_length("pattern") + F.octet_length("network") + 16), F.lit(0))).first()[0] <= BROADCAST_BYTES
    found = hosts.select("_h", F.explode(suffixes).alias("x")).select("_h", "x.*").join(F.broadcast(once) if few else once, ["pattern", "exact"])
    best = found.groupBy("_h").agg(F.max_by("network", F.struct("exact", F.length("pattern"))).alias("network"))
    return rows.withColumn("_h", own).join(best, "_h", "left").drop("_h").withColumn("network", F.coalesce("network", F.lit(other)))


#: Of a network, how many segments a profile's path has (least, most), what its first segment is (a leading @ as such), what it
#: is not. Networks without an entry have no profiles.
_SHARES, _SEVERAL = "share intent login signup", 99
PROFILES = {
    "github": (1, 1, "", "about account blog contact customer enterprise events explore features home issues join login logout marketplace new nonprofit notifications organizations pricing pulls search security settings site sponsors topics trending"),
    "linkedin": (2, _SEVERAL, "in", ""), "x": (1, 1, "", "compose explore hashtag home i intent login messages notifications search settings share signup tos"), "reddit": (2, _SEVERAL, "user u", ""),
    "bluesky": (2, _SEVERAL, "profile", ""), "youtube": (1, _SEVERAL, "@ channel c user watch", ""), "cssbattle": (1, _SEVERAL, "", "play"), "codepen": (1, _SEVERAL, "", "pen"),
    "facebook": (1, _SEVERAL, "", "share sharer dialog login watch"), "discord": (1, _SEVERAL, "users invite", ""), "telegram": (1, _SEVERAL, "", "share shareurl login signup"), "librefm": (2, _SEVERAL, "user", ""), "threads": (1, _SEVERAL, "", ""),
}
PROFILES |= {"gitlab": PROFILES["github"]} | {n: (1, _SEVERAL, "", _SHARES) for n in "instagram tiktok pinterest snapchat twitch patreon keybase vk pixiv zhihu weibo naver".split()}
PROFILES |= {n: (0, _SEVERAL, "", "") for n in "medium substack tumblr bandcamp soundcloud spotify vimeo flickr bilibili xiaohongshu line kakao odnoklassniki stackoverflow matrix".split()}


def profile_rules(spark) -> DataFrame:
    """PROFILES as rows: network, least, most, first, refused. On mastodon a path of one segment, or one that begins with @, is a profile: two rows."""
    rows = [(n, a, z, first.split(), not_.split()) for n, (a, z, first, not_) in PROFILES.items()] + [("mastodon", 1, 1, [], []), ("mastodon", 1, _SEVERAL, ["@"], [])]
    return spark.createDataFrame(rows, "network string, least int, most int, first array<string>, refused array<string>")


def profiles(rows: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """rows (with network) with profile: whether a rule of their network takes their path for a profile's. Rules are few."""
    segments = F.filter(F.split(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    n, first = F.size(segments), F.lower(F.coalesce(F.get(segments, F.lit(0)), F.lit("")))
    by = rules.groupBy("network").agg(F.collect_list(F.struct("least", "most", "first", "refused")).alias("_rules"))
    fits = lambda r: n.between(r["least"], r["most"]) & ((F.size(r["first"]) == 0) | F.exists(r["first"], lambda f: (f == first) | ((f == "@") & first.startswith("@")))) & ~F.array_contains(r["refused"], first)
    gg = (urls.host(F.col(url)) == "discord.gg") & (F.col("network") == "discord")
    return rows.join(F.broadcast(by), "network", "left").withColumn("profile", F.coalesce(F.exists("_rules", fits), F.lit(False)) | F.coalesce(gg, F.lit(False))).drop("_rules")
