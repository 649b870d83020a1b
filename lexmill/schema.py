"""The span model: candidate and accepted entities of a text, in code points of its normalised form."""

from __future__ import annotations

SPAN = "struct<start:int,end:int,entity_type:string,surface:string,score:double,priority:int,rule_id:string,anonymize:boolean,protect:boolean,seq:int>"
EMPTY_SPANS = f"CAST(array() AS array<{SPAN}>)"
