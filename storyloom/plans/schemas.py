"""Table layouts, one place for all readers. ``story_id`` leads every key, so that many stories run at once."""

from __future__ import annotations

ENTITY_MENTIONS = (
    "story_id string, scene_idx int, pos int, canonical_name string, surface_forms array<string>, category string, physical_visualizable boolean, keep boolean,"
    " action double, visual double, state double, confidence double, evidence array<string>"
)
SPOKEN_MENTIONS = (
    "story_id string, scene_idx int, pos int, canonical_name string, surface_forms array<string>, category string, physical_visualizable boolean,"
    " direct_visual_evidence boolean, mention_strength double, confidence double, evidence array<string>"
)
SCENES = (
    "story_id string, scene_idx int, scene_idx_non_omitted int, scene_label_raw string, scene_label_int int, marker_type string, heading string, page_start int, page_end int,"
    " lines array<string>"
)
SUBTITLES = "story_id string, index int, start_sec double, end_sec double, text string"
SCORES = "struct<narrative_action_centrality:double,visual_grounded_score:double,state_change_potential:double,confidence:double>"
EVENTS = (
    "story_id string, event_idx int, entity_key string, canonical_name string, entity_type string, surface_forms array<string>, scene_a int, scene_b int, gap_jump int, gap_absent int,"
    f" freq_scenes int, coverage double, scores {SCORES}, scenes array<int>"
)
SCENE_OBJECTS = (
    "story_id string, scene_idx int, pos int, object_id string, canonical_name string, surface_forms array<string>, normalized_aliases array<string>, source_channels array<string>,"
    " category string, direct_visual_evidence boolean, mention_strength_max double, confidence_max double, evidence array<string>"
)
SCENE_HEADINGS = "story_id string, scene_idx int, heading string"
SCENE_CLIMAX = "story_id string, scene_idx int, heading string, climax_score int"
STORY_META = "story_id string, q50 double, q75 double, total_scenes int"

#: JSON files as the stages exchange them.
EVENTS_JSON = (
    "meta struct<scenes_non_omitted:int,gap_quantiles:struct<q50:double,q75:double>>, events array<struct<entity_key:string,canonical_name:string,entity_type:string,surface_forms:array<string>,"
    "scene_a_idx_non_omitted:int,scene_b_idx_non_omitted:int,gap_jump:int,gap_absent:int,freq_scenes:int,coverage:double,page_a:int,page_b:int,heading_a:string,heading_b:string,"
    f"context_a:array<string>,context_b:array<string>,scores:{SCORES},provenance:struct<scenes_non_omitted_list:array<int>>,difficulty:struct<gap_level:string>>>"
)
INVENTORY_JSON = (
    "meta struct<scenes_non_omitted:int>, scenes map<string,struct<heading:string,page_start:int,page_end:int,merged_loose_objects:array<struct<object_id:string,canonical_name:string,"
    "surface_forms:array<string>,normalized_aliases:array<string>,source_channels:array<string>,source_channel:string,category:string,direct_visual_evidence:boolean,mention_strength_max:double,"
    "mention_strength:double,confidence_max:double,confidence:double,evidence:array<string>>>>>"
)
CLIMAX_JSON = "meta struct<scenes_non_omitted:int>, scenes map<string,struct<heading:string,climax_score:int,objects:array<string>>>"
SUBTITLES_JSON = "segments array<struct<index:int,start_sec:double,end_sec:double,text:string>>"
