"""Enumerations and schemas (as DDL) of the catalog. Codes are fixed values: stored rows hold the numbers."""

from __future__ import annotations

LIST_STATUS = {"unapproved": 0, "approved": 1, "rejected": 2, "active": 3}
PENALTY_TYPE = {"number_of_voters": 0, "percentage_western": 1, "voter_names_unknown": 2, "voter_count_unknown": 3, "category_specific": 4, "location_specific": 5, "num_years_covered": 6, "voter_count_estimated": 7, "creator_specific": 8}
CATEGORY_TYPE = {"genre": 0, "location": 1, "subject": 2, "theme": 3, "game_mode": 4, "player_perspective": 5}
AUTHOR_ROLE = {"author": 0, "editor": 1}
GENDER = {"male": 0, "female": 1, "non_binary": 2, "unspecified": 3}
BOOK_LENGTH = {"very_short": 0, "short": 1, "medium": 2, "moderate": 3, "long": 4, "very_long": 5}
DESCRIPTION_RANK = {"deprecated": -1, "normal": 0, "preferred": 1}
DESCRIPTION_SOURCES = ["manual", "ai_generated", "goodreads", "wikipedia", "openlibrary", "publisher", "musicbrainz", "igdb", "other"]
#: Item type of each list type, as integrity checks need it.
ITEM_OF_LIST = {"Books::List": "Books::Book", "Games::List": "Games::Game", "Movies::List": "Movies::Movie", "Music::Albums::List": "Music::Album", "Music::Songs::List": "Music::Song"}

LISTS = "id long, type string, name string, status int, year_published int, number_of_voters int, num_years_covered int, high_quality_source boolean, yearly_award boolean, voter_names_unknown boolean, voter_count_unknown boolean, voter_count_estimated boolean, location_specific boolean, category_specific boolean, creator_specific boolean"
LIST_ITEMS = "list_id long, listable_type string, listable_id long, position int"
RANKED_ITEMS = "item_id long, rank int, score decimal(10,2)"
REVIEWS = "id long, user_id long, reviewable_id long, rating int, body string, created_at timestamp"
DOCUMENTS = "id long, title string, category_ids array<long>, country_ids array<long>, language_id long, book_length int, first_published_year int, ranked_position int"
#: Elements of an imported list: what an extraction of songs or albums returns.
IMPORTED_ITEMS = "array<struct<rank:int,title:string,artists:array<string>,album:string,release_year:int,song_id:bigint,mb_recording_id:string,ai_match_invalid:boolean>>"
