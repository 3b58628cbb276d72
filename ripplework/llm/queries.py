"""The operators over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from . import bpe, chat, langid, media, mixing, quality, rules, secrets, sharding, simhash
from .common import table


def op1_chat(spark, sf_dir):
    return chat.digest(chat.format_turns(chat.with_conflict(table(spark, sf_dir, "conversations"))))


def op2_media(spark, sf_dir):
    return media.media_digest(table(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.cluster_table(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return quality.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark, sf_dir):
    return secrets.secret_table(table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    return bpe.token_digest(table(spark, sf_dir, "documents"))


def op8_langid(spark, sf_dir):
    return langid.language_table(table(spark, sf_dir, "documents"))


def op9_rules(spark, sf_dir):
    return rules.rule_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark, sf_dir):
    return mixing.mix_table(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_chat, op2_media, op3_sharding, op4_simhash, op5_quality, op6_secrets, op7_bpe, op8_langid, op9_rules, op10_mixing)
}
ORACLE_SQL = {"op1_chat": chat.SQL, "op10_mixing": mixing.SQL}
