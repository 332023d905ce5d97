"""Templates of the four judge prompts."""

# Judge prompt bodies; ${text} and ${summary} are the slots.
GEVAL_FLUENCY = """You will be given one summary written for a TED Talk transcript.

Your task is to rate the summary on one metric.

Please make sure you read and understand these instructions carefully. Please keep this document open while reviewing, and refer to it as needed.


Evaluation Criteria:

Fluency (1-3): the quality of the summary in terms of grammar, spelling, punctuation, word choice, and sentence structure.

- 1: Poor. The summary has many errors that make it hard to understand or sound unnatural.
- 2: Fair. The summary has some errors that affect the clarity or smoothness of the text, but the main points are still comprehensible.
- 3: Good. The summary has few or no errors and is easy to read and follow.


Example:

Summary:

${summary}


Evaluation Form (scores ONLY):

- Fluency (1-3):"""

GEVAL_RELEVANCE = """You will be given one summary written for a TED Talk transcript.

Your task is to rate the summary on one metric.

Please make sure you read and understand these instructions carefully. Please keep this document open while reviewing, and refer to it as needed.

Evaluation Criteria:

Relevance (1-5) - selection of important content from the source. The summary should include only important information from the source document. Annotators were instructed to penalize summaries which contained redundancies and excess information.

Evaluation Steps:

1. Read the summary and the source document carefully.
2. Compare the summary to the source document and identify the main points of the transcript.
3. Assess how well the summary covers the main points of the transcript, and how much irrelevant or redundant information it contains.
4. Assign a relevance score from 1 to 5.


Example:


Source Text:

${text}

Summary:

${summary}


Evaluation Form (scores ONLY):

- Relevance:"""

# The trailing blanks after "facts.", "Source Text:" and "Summary:" belong to it.
GEVAL_CONSISTENCY = (
    """You will be given a TED talk transcript. You will then be given one summary written for this transcript.

Your task is to rate the summary on one metric.

Please make sure you read and understand these instructions carefully. Please keep this document open while reviewing, and refer to it as needed.


Evaluation Criteria:

Consistency (1-5) - the factual alignment between the summary and the summarized source. A factually consistent summary contains only statements that are entailed by the source document. Annotators were also asked to penalize summaries that contained hallucinated facts.\x20

Evaluation Steps:

1. Read the transcript carefully and identify the main facts and details it presents.
2. Read the summary and compare it to the transcript. Check if the summary contains any factual errors that are not supported by the transcript.
3. Assign a score for consistency based on the Evaluation Criteria.


Example:


Source Text:\x20

${text}

Summary:\x20

${summary}


Evaluation Form (scores ONLY):

- Consistency:""")

GEVAL_COHERENCE = """You will be given one summary written for a TED talk transcript.

Your task is to rate the summary on one metric.

Please make sure you read and understand these instructions carefully. Please keep this document open while reviewing, and refer to it as needed.

Evaluation Criteria:

Coherence (1-5) - the collective quality of all sentences. We align this dimension with the DUC quality question of structure and coherence whereby "the summary should be well-structured and well-organized. The summary should not just be a heap of related information, but should build from sentence to a coherent body of information about a topic."

Evaluation Steps:

1. Read the transcript carefully and identify the main topic and key points.
2. Read the summary and compare it to the transcript. Check if the summary covers the main topic and key points of the transcript, and if it presents them in a clear and logical order.
3. Assign a score for coherence on a scale of 1 to 5, where 1 is the lowest and 5 is the highest based on the Evaluation Criteria.


Example:


Source Text:

${text}

Summary:

${summary}


Evaluation Form (scores ONLY):

- Coherence:"""
# End of the fixed values.

JUDGE_TEMPLATES = {"fluency": GEVAL_FLUENCY, "coherence": GEVAL_COHERENCE,
                   "consistency": GEVAL_CONSISTENCY, "relevance": GEVAL_RELEVANCE}
