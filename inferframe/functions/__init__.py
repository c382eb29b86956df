"""Column functions: text, ids, costs, messages, images and model responses. All of them stay in the JVM unless they say otherwise."""
