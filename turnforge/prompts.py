"""Default prompt wording.

Prompt text is data: callers pass their own table or dict.  The wording below
is this project's own.  Only the layout (which parts appear, in what order,
with or without newlines) carries meaning for the pipeline.
"""

from turnforge.constants import LANG_LINE as LANG_LINE  # a fixed value, not wording

DEFAULT_PROMPTS = {
    "starter_system": (
        "Write the first message a user would send in the scene described below. "
        "Keep to the stated language and culture and give real names, not placeholders."
    ),
    "starter_verdict_system": (
        "Read the opening message below. Answer Yes if it is natural and uses no placeholder "
        "names; otherwise answer No and give the reason."
    ),
    "user_turn_system": (
        "You act as the user in a conversation with an assistant. Reply with the user's next "
        "message only, in at most two sentences."
    ),
    "user_turn_cue": "Write the next user message.",
    "assistant_system": "You are a helpful assistant. Answer in the language of the conversation.",
    "turn_verdict_system": (
        "Decide whether the response fits the scene and the conversation. Answer Yes, or No "
        "followed by a short reason."
    ),
    "judge_system": (
        "Grade the dialogue below. Return one JSON object with a label and a comment for every "
        "issue key, plus an overall rating from 1 to 5."
    ),
}

# Layout fragments of rendered prompts (this project's wording).
SCENE_HEAD = "Scene: "
HISTORY_HEAD = "Conversation:\n"
RESPONSE_HEAD = "Response to check:\n"
DIALOGUE_HEAD = "Dialogue:\n"
REGEN_BLOCK_HEAD = "Rejected attempt:\nuser:"
REGEN_BLOCK_REASON = "\nReason given:"
