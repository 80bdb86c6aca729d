"""The shipped rules of calls: word weights, patterns, phrases and markers. Every operator takes others as arguments.

All of this is fixed values: results depend on each of them.
"""

#: Weights of words in a turn's mood, and of phrases beside them.
MOOD_WORDS = {
    "angry": -0.8, "furious": -0.9, "unacceptable": -0.8, "ridiculous": -0.7, "absurd": -0.7, "terrible": -0.7, "awful": -0.7, "horrible": -0.8,
    "useless": -0.7, "frustrated": -0.6, "frustrating": -0.6, "annoyed": -0.5, "upset": -0.6, "disappointed": -0.5, "disgusted": -0.8,
    "harassment": -0.9, "lied": -0.8, "lying": -0.8, "scam": -0.8, "fraud": -0.4, "stolen": -0.6, "humiliating": -0.8, "humiliated": -0.8,
    "embarrassing": -0.6, "wasted": -0.6, "waste": -0.5, "again": -0.15, "still": -0.15, "never": -0.3, "nobody": -0.4, "refuse": -0.5,
    "complaint": -0.5, "complain": -0.5, "lawyer": -0.7, "legal": -0.4, "regulator": -0.6, "sue": -0.7, "court": -0.5, "bounced": -0.5,
    "declined": -0.4, "denied": -0.5, "wrong": -0.4, "broken": -0.5, "crashes": -0.5, "failed": -0.5, "frozen": -0.4, "sorry": -0.1,
    "unhappy": -0.7, "worse": -0.5, "problem": -0.3, "issue": -0.25, "dispute": -0.3, "cannot": -0.2, "can't": -0.2,
    "thanks": 0.4, "appreciate": 0.6, "great": 0.5, "perfect": 0.6, "excellent": 0.7, "wonderful": 0.6, "fantastic": 0.6, "amazing": 0.6,
    "good": 0.35, "helpful": 0.6, "happy": 0.6, "pleased": 0.5, "relief": 0.6, "sorted": 0.5, "resolved": 0.5, "works": 0.4, "worked": 0.45,
    "fixed": 0.5, "glad": 0.5, "fine": 0.25, "okay": 0.15, "ok": 0.15, "sure": 0.15, "please": 0.1, "yes": 0.1,
}
MOOD_PHRASES = {"thank you": 0.5, "no one": -0.4, "locked out": -0.4, "master card": 0.0}
NEGATIONS = ["not", "no", "never", "don't", "doesn't", "didn't", "isn't", "wasn't", "won't", "can't", "cannot", "nothing"]
INTENSIFIERS = {"very": 1.4, "extremely": 1.7, "really": 1.3, "so": 1.2, "incredibly": 1.6, "absolutely": 1.5, "completely": 1.4}

#: Fixed values: (pattern, weight, label) of what points to an escalation, and the labels that mean one was asked for.
ESCALATION = [
    (r"(?i)\b(?:get|want|need|speak to|talk to)\s+(?:me\s+)?(?:a\s+)?(?:supervisor|manager)\b", 0.9, "supervisor_request"),
    (r"(?i)\bsupervisor\b", 0.6, "supervisor_mention"),
    (r"(?i)\bmanager\b", 0.6, "manager_mention"),
    (r"(?i)\b(?:speaking|talking|talk)\s+to\s+(?:a\s+)?lawyer\b", 0.85, "legal_threat"),
    (r"(?i)\blawyer\b|\battorney\b|\bsolicitor\b", 0.7, "legal_threat"),
    (r"(?i)\b(?:file|filing|report)\s+a\s+(?:complaint|grievance)\b", 0.75, "complaint_threat"),
    (r"(?i)\bregulator\b|\bombudsman\b|\bconsumer protection\b", 0.8, "regulator_threat"),
    (r"(?i)\bcancel (?:my|the) account\b|\bclose (?:my|the) account\b", 0.5, "churn_threat"),
    (r"(?i)\b(?:third|fourth|fifth|\d+(?:st|nd|rd|th))\s+time\s+(?:i've|i have|calling)\b", 0.7, "repeat_contact"),
    (r"(?i)\bthis is (?:harassment|ridiculous|unacceptable)\b", 0.7, "hostility"),
    (r"(?i)\bwasted?\s+(?:\w+\s+){0,2}hours\b", 0.6, "effort_complaint"),
    (r"(?i)\bnobody (?:will|can|has)\b|\bno one (?:will|can|has)\b", 0.55, "helplessness"),
    (r"(?i)\bin writing\b", 0.4, "documentation_demand"),
]
ESCALATED_LABELS = ["supervisor_request", "supervisor_mention", "manager_mention"]

#: Weights of phrases by intent, in catalog order.
INTENTS = {
    "billing_dispute": {
        "dispute": 3.0, "charge": 2.0, "charged": 2.2, "double charged": 3.5, "didn't make": 2.0, "don't recognise": 2.5, "don't recognize": 2.5,
        "fee": 2.0, "overcharged": 3.0, "wrong amount": 2.5, "service charge": 2.0,
    },
    "payment_arrangement": {
        "payment plan": 3.5, "payment arrangement": 3.5, "make a payment": 3.0, "pay my balance": 3.0, "can't pay": 2.5, "instalment": 3.0,
        "installment": 3.0, "pay off": 2.0, "monthly": 1.2, "pay this off": 2.5,
    },
    "account_closure": {"close my account": 4.0, "close the account": 3.5, "cancel my account": 3.5, "closure": 3.0, "closing": 1.5},
    "technical_support": {
        "app": 2.0, "crashes": 3.0, "not working": 2.5, "error": 2.0, "locked out": 2.5, "password": 1.5, "website": 2.0, "declined": 2.0,
        "pending": 2.0, "transfer": 1.5, "login": 2.0, "update": 1.0,
    },
    "fraud_report": {
        "fraud": 3.5, "didn't make": 2.5, "unauthorised": 3.5, "unauthorized": 3.5, "stolen": 3.0, "someone else": 2.0, "fraudulent": 3.5,
        "security hold": 2.0,
    },
    "address_change": {"change my address": 4.0, "update my address": 4.0, "moved": 2.5, "new address": 3.0, "mailing address": 3.0},
    "refund_request": {"refund": 3.5, "money back": 3.0, "reimburse": 3.0, "credit back": 2.5, "refunded": 3.5},
    "plan_upgrade": {"upgrade": 3.5, "premium": 3.0, "sign me up": 3.0, "enrol": 2.5, "enroll": 2.5, "new plan": 3.0, "tier": 2.5},
    "balance_inquiry": {"balance": 3.0, "how much": 2.0, "available balance": 4.0, "check the balance": 4.0},
    "collections": {
        "past due": 3.5, "collect a debt": 4.0, "debt collector": 4.0, "overdue": 3.0, "recovery": 2.5, "arrears": 3.0, "behind on": 2.5,
    },
    "card_replacement": {"replacement": 3.5, "new card": 3.0, "damaged": 2.5, "replace my card": 4.0, "lost my card": 3.5},
    "password_reset": {"password": 3.0, "reset": 2.5, "locked out": 2.5, "can't log in": 3.0, "sign in": 2.0},
    "general_inquiry": {
        "question": 1.5, "what time": 2.0, "hours": 2.0, "wondering": 1.5, "branch": 1.5, "order number": 2.0, "power of attorney": 2.0,
    },
}

#: What says how a call ended.
RESOLVED = ["all set", "that's everything", "that worked", "went through", "sorted", "thank you", "that's all", "resolved", "confirmed", "you're all set"]
ESCALATED = ["supervisor", "escalat", "manager", "transfer you"]
FOLLOW_UP = [
    "business days", "follow up", "we'll be in touch", "you'll hear back", "within twenty-four hours", "next month", "call you back", "mail the",
    "send you", "provisional credit",
]

#: Fixed values: (pattern, owner) of commitments; their groups, joined by a blank, are the item. And what begins a phrase that is none.
ACTIONS = [
    (r"(?i)\bi'?(?:ll|ve| will| have)\s+(?:go ahead and\s+)?(\w+(?:\s+\w+){1,7})", "agent"),
    (r"(?i)\bi'?m\s+(?:going to\s+)?(escalating|requesting|crediting|freezing|sending|mailing|releasing)\s+(\w+(?:\s+\w+){0,6})", "agent"),
    (r"(?i)\bwe'?ll\s+(\w+(?:\s+\w+){1,7})", "agent"),
    (r"(?i)\byou'?ll (?:need to|have to)\s+(\w+(?:\s+\w+){1,7})", "customer"),
    (r"(?i)\b(?:i can|let me)\s+(request|reopen|cancel|order|submit|send|mail|credit)\s+(\w+(?:\s+\w+){0,6})", "agent"),
]
ACTION_NOISE = r"(?i)^(?:got|have|see|understand|hear|know|think|need|got it|look|check that)\b"
