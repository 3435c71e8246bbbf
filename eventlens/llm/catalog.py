"""The query modules of this subpackage."""

from . import chat, clusters, decontaminate, exact, licences, mixing, pages, passages, phrases, quality, sharding, simhash, substrings

MODULES = [sharding, simhash, substrings, pages, decontaminate, licences, passages, phrases, quality, mixing, chat,
           clusters, phrases, exact]
